"""sedimenta: set-oriented retrieval, knowledge and usage analytics on PySpark."""
