"""Column helpers that read semi-structured answers and settings with defined fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_json(text: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a non-blank value."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, p)), F.lit("")) for p in paths])


def to_int(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def to_double(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def to_bool(text: Column, default: bool) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(default)


def first_label(text: Column, labels: list[str], default: str) -> Column:
    """The first of the labels, in their order, that occurs in the text."""
    out = None
    for label in labels:
        hit = F.lower(text).contains(label)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def prefix_parts(prefix: Column) -> Column:
    """``vec:project:source:*`` -> struct(project, source); a missing part is null and filters nothing."""
    parts = F.split(prefix, ":")
    part = lambda i: F.nullif(F.nullif(F.get(parts, F.lit(i)), F.lit("*")), F.lit(""))
    return F.struct(part(1).try_cast("long").alias("project"), part(2).alias("source"))


def clone_url(payload: Column) -> Column:
    """The repository a webhook's JSON payload is about: a clone address, else a page's with ``.git`` behind it."""
    page = lambda p: F.concat(F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")), F.lit(".git"))
    return F.coalesce(first_json(payload, "$.repository.clone_url"), page("$.repository.html_url"), first_json(payload, "$.project.git_http_url"), page("$.project.web_url"))


#: Words that tell what a question about code asks for, and the forms of names in it.
CALL_CHAIN = "调用链|谁调|call chain|被谁|调用关系|依赖链|影响分析|trace|call graph|调用了哪些|depend"
METHOD = "方法|签名|参数|返回值|参数类型|方法名|在哪里|where is|definition|signature|method"
IMPLEMENTATION = "实现|如何|怎么|原理|逻辑|算法|流程|原因|为何|implementation|how does|logic|algorithm"
CALLED = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
CHAIN = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+)"
HUMP = r"([a-z]+|[A-Z][a-z]*)"


def question_intent(q: Column) -> Column:
    """CALL_CHAIN, METHOD_LOOKUP, IMPLEMENTATION or UNKNOWN; a dotted name without a call asks for its chain."""
    low, called = F.lower(q), q.rlike(CALLED)
    method = F.when(~called & q.rlike(CHAIN), "CALL_CHAIN").otherwise("METHOD_LOOKUP")
    return F.when(low.rlike(CALL_CHAIN), "CALL_CHAIN").when(low.rlike(METHOD), method).when(low.rlike(IMPLEMENTATION), "IMPLEMENTATION").when(called, "METHOD_LOOKUP").otherwise("UNKNOWN")


def asked_method(q: Column) -> Column:
    """The name that is called, else the last part of a dotted name, else null."""
    called, chain = (F.nullif(F.regexp_extract(q, x, 1), F.lit("")) for x in (CALLED, CHAIN))
    return F.coalesce(called, F.substring_index(chain, ".", -1))


def asked_class(q: Column) -> Column:
    """The first part of a dotted name, else the first run of letters that begins with a capital, else null."""
    chain = F.nullif(F.regexp_extract(q, CHAIN, 1), F.lit(""))
    humps = F.filter(F.regexp_extract_all(q, F.lit(HUMP), F.lit(1)), lambda w: w.rlike("^[A-Z]"))
    return F.coalesce(F.substring_index(chain, ".", 1), F.get(humps, F.lit(0)))
