"""Search parameters by scenario and by the features of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parameters of each scenario.
STRATEGIES = (
    # scenario, chunk size, overlap, skipped checks, hypothesis, diversity, least chunks, dense k, pool multiplier, model weight
    ("learn", 1024, 128, [1, 2], False, False, 6, 10, 2, 0.5),
    ("interview", 2048, 320, [], True, True, 4, 4, 1, 0.7),
    ("safety", 256, 64, [], True, True, 4, 4, 1, 0.7),
    ("code", 384, 0, [], True, False, 4, 4, 1, 0.7),
    ("doc", 500, 80, [], True, True, 4, 4, 1, 0.7),
    ("default", 500, 80, [], True, True, 4, 4, 1, 0.7),
)
STRATEGY = "scenario string, chunk_size int, chunk_overlap int, skipped array<int>, hypothesis boolean, diversity boolean, least_chunks int, dense_k int, pool_multiplier int, model_weight double"
#: Words of questions about code, design and details.
CODE = "method|function|class|interface|implement|call|invoke|调用|方法|函数|类|接口|实现|代码|实现逻辑|call chain|调用链|method signature|方法签名|参数|return|exception|算法|algorithm|bug|defect"
DESIGN = "architecture|design|pattern|structure|架构|设计|模式|结构|模块|module|component|组件|system|系统|技术选型|decision|decide|规范|standard|约定|convention"
DETAIL = "how|how to|怎么写|实现|implement|code|代码|line|行|具体|detail|细节|example|示例"
OVERVIEW = "这是什么|概述|简介|what is|overview|summary"
WHY = "为什么|why"


def strategies(spark: SparkSession) -> DataFrame:
    """One row a scenario; six rows, so it may be broadcast."""
    return spark.createDataFrame(STRATEGIES, STRATEGY)


def with_strategy(df: DataFrame, scenario: str) -> DataFrame:
    """Adds the parameters of each row's scenario; null and unknown ones have those of ``default``."""
    known = strategies(df.sparkSession)
    resolved = F.when(F.col(scenario).isin([s[0] for s in STRATEGIES]), F.col(scenario)).otherwise("default")
    return df.withColumn("resolved", resolved).join(F.broadcast(known), F.col("resolved") == known["scenario"]).drop(known["scenario"], "resolved")


def routed(question: Column) -> Column:
    """struct(rule, chunk_size, hypothesis, diversity, dense_k, top_n): the first rule that holds decides."""
    low, n = F.lower(question), F.length(question)
    rule = (
        F.when(low.rlike(CODE) & low.rlike(DETAIL), 1).when(low.rlike(f"{DESIGN}|{WHY}"), 2).when(low.rlike(OVERVIEW), 3)
        .when(n < 15, 4).when(n > 80, 5).otherwise(6)
    )
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), rule)
    return F.struct(
        rule.alias("rule"), pick(384, 500, 800, 500, 800, 500).alias("chunk_size"), pick(True, True, False, False, True, True).alias("hypothesis"),
        pick(False, True, True, True, True, True).alias("diversity"), pick(6, 10, 6, 6, 12, 8).alias("dense_k"), pick(3, 5, 3, 4, 4, 4).alias("top_n"),
    )


def method_context(context: Column) -> Column:
    """Whether a context shows methods, so that an answer keeps to them."""
    return F.coalesce(context.contains("【方法】") | context.contains("【签名】"), F.lit(False))
