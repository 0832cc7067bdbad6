"""Text preparation: types, splitting, masking, clean-up and the strings that are embedded or shown."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as Java's strip() sees it (a no-break space stays).
STRIP = r"[\s  -    　]"


def detect_type(name: Column, text: Column) -> Column:
    """MARKDOWN or TEXT by file name, else by the text's first marks."""
    marks = text.rlike(r"(?m)^#{1,6}\s+\S") | text.contains("```") | text.contains("|")
    by_name = F.lower(F.coalesce(name, F.lit("")))
    return F.when(by_name.rlike(r"\.(md|markdown|rst)$"), "MARKDOWN").when((by_name.rlike(r"\.txt$") | ~by_name.contains(".")) & (F.length(text) >= 20) & marks, "MARKDOWN").otherwise("TEXT")


def hard_split(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; the last ends with the text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    pieces = df.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return pieces.select(key, "piece_no", F.expr(f"substring({text}, piece_no * {step} + 1, {size})").alias("piece"))


def mask(text: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    """Listed words replaced by as many stars in one pass from the left, at each place the longest word that is there."""
    pattern = F.lit(("(?i)" if ignore_case else "") + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))))
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, w: F.concat(g, F.coalesce(F.call_function("repeat", F.lit("*"), F.length(w)), F.lit("")))), "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)))


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags, entities decoded, white space joined."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unfence(text: Column) -> Column:
    """The body of the first fenced block, else the text itself."""
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)
    return F.regexp_replace(F.when(text.contains("```") & (fenced != ""), fenced).otherwise(text), r"^\s+|\s+$", "")


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def context_description(heading: Column, content: Column, given: Column) -> Column:
    """A given description, else one made of the heading or of the first 50 characters."""
    head = F.when(F.coalesce(F.trim(heading), F.lit("")) != "", F.concat(F.lit("文档章节："), heading))
    start = F.when(F.length(content) > 50, F.concat(F.substring(content, 1, 50), F.lit("..."))).otherwise(content)
    return F.coalesce(F.when(F.trim(given) != "", given), head, start)


def embedding_text(description: Column, content: Column) -> Column:
    return F.when(F.coalesce(F.trim(description), F.lit("")) != "", F.concat(description, F.lit("\n\n"), content)).otherwise(content)


def first_heading(content: Column) -> Column:
    return F.regexp_extract(content, r"(?m)^#{1,4}[ \t]+(\S[^\r\n]*)$", 1)


_HEADING = re.compile(r"^(#{1,4})\s+(.+)$")
_PROTECTED = re.compile(r"```.*?(?:```|\Z)|<(table|pre|div)\b.*?</\1>", re.S | re.I)


def paragraphs(text: str, long: int = 2000, size: int = 1000, overlap: int = 100, least: int = 100) -> list[str]:
    """Blank-line paragraphs: long ones are cut hard, short ones wait for the next."""
    out, waiting = [], ""
    for part in re.split(r"\r?\n\s*\r?\n", text):
        part = part.strip()
        if not part:
            continue
        if len(part) > long:
            if waiting:
                out.append(waiting)
                waiting = ""
            step = size - overlap
            out += [part[i : i + size] for i in range(0, max(1, -(-(len(part) - overlap) // step) * step), step)]
        elif len(part) < least:
            waiting = f"{waiting}\n\n{part}" if waiting else part
        else:
            out.append(f"{waiting}\n\n{part}" if waiting else part)
            waiting = ""
    return out + ([waiting] if waiting else [])


def sections(text: str) -> list[tuple[str, int, str]]:
    """(heading, level, body) of a markdown text; what stands before the first heading is its own section."""
    found, lines, inside = [("", 0, [])], text.splitlines(), False
    for line in lines:
        inside ^= line.lstrip().startswith("```")
        m = None if inside else _HEADING.match(line)
        if m:
            found.append((m.group(2).strip(), len(m.group(1)), []))
        else:
            found[-1][2].append(line)
    return [(h, n, "\n".join(body)) for h, n, body in found if any(b.strip() for b in body)]


_TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")


def block_chunks(body: str, short: int = 50, most: int = 2000) -> list[str]:
    """Paragraphs of a section with fenced code and HTML blocks kept whole. Tables and code are chunks of their own; a
    paragraph of up to ``short`` characters joins the chunk before it while that stays below ``most``."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m.group())
        return f"\0{len(kept) - 1}\0"

    out: list[str] = []
    for part in re.split(r"\n\s*\n", _PROTECTED.sub(hide, body)):
        part = re.sub(r"\0(\d+)\0", lambda m: kept[int(m.group(1))], part)
        code, part = part.startswith("    ") or "```" in part, part.strip()
        if not part:
            continue
        lines = part.split("\n")
        table = len(lines) > 1 and _TABLE_ROW.match(lines[0]) and "---" in lines[1]
        if not (table or code) and len(part) <= short and out and len(out[-1]) + len(part) < most:
            out[-1] = f"{out[-1]}\n\n{part}"
        else:
            out.append(part)
    return out


def semantic_chunks(text: str) -> list[tuple[str, int, str]]:
    """(heading, level, content): the sections of a markdown text cut into blocks; other texts are cut into paragraphs."""
    found = sections(text)
    if all(not level for _, level, _ in found):
        return [("", 0, p) for p in paragraphs(text)]
    return [(heading, level, c) for heading, level, body in found for c in block_chunks(body)]


_ANY_HEADING = re.compile(r"(?m)^#{1,6}\s+.+$")


def packed_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed into chunks of up to ``size``; a new chunk begins with the last ``overlap`` characters of the one
    before it. A longer paragraph is cut into windows."""
    out, held = [], ""

    def flush() -> None:
        nonlocal held
        if held:
            out.append(held.strip())
            held = ""

    for part in re.split(r"\n\s*\n|\r\n\s*\r\n", text):
        part = part.strip()
        if not part:
            continue
        if len(part) > size:
            flush()
            out += [part[k : k + size] for k in range(0, max(len(part) - overlap, 1), size - overlap)]
        else:
            if len(held) + len(part) > size:
                flush()
                held = out[-1][-overlap:] if out and overlap > 0 else ""
            held += part + "\n"
    flush()
    return out


def heading_chunks(text: str, size: int = 500, overlap: int = 80) -> list[str]:
    """A markdown text by headings, each block behind the heading it stands under; blocks of more than twice ``size`` and
    texts with less than two blocks are packed by paragraphs."""
    marks = list(_ANY_HEADING.finditer(text))
    if not marks:
        return packed_paragraphs(text, size, overlap)
    blocks, last, heading = [], 0, ""
    for m in marks:
        if m.start() > 0 and text[last : m.start()].strip():
            blocks.append(f"{heading}\n{text[last : m.start()].strip()}")
        last, heading = m.start(), m.group().strip()
    if text[last:].strip():
        blocks.append(text[last:].strip())
    if len(blocks) <= 1:
        return packed_paragraphs(text, size, overlap)
    return [c for b in blocks for c in (packed_paragraphs(b, size, overlap) if len(b) > 2 * size else [b])]


def heading_documents(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 80) -> DataFrame:
    """(key, seq, content): ``heading_chunks`` of whole texts; nulls and blanks give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(rows[key], rows[text]) for i, c in enumerate(heading_chunks(t, size, overlap))], columns=[key, "seq", "content"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, seq int, content string")


def chunk_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, heading, heading_level, content): structure-aware chunks of whole texts; nulls and blanks give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, i, *c) for k, t in zip(rows[key], rows[text]) for i, c in enumerate(semantic_chunks(t))], columns=[key, "seq", "heading", "heading_level", "content"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, seq int, heading string, heading_level int, content string")


def shown_context(hits: DataFrame, key: str, rank: str, file: str, seq: str, content: str) -> DataFrame:
    """One text per key: numbered fragments with their source, in rank order."""
    line = F.concat(F.lit("[片段"), F.col(rank).cast("string"), F.lit(" 来源:"), F.coalesce(F.col(file), F.lit("")), F.lit(" #"), F.coalesce(F.col(seq).cast("string"), F.lit("")), F.lit("]\n"), F.coalesce(F.col(content), F.lit("")), F.lit("\n\n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("t")))), lambda s: s["t"])
    return hits.groupBy(key).agg(F.array_join(parts, "").alias("context"))


def citations(hits: DataFrame, key: str, rank: str, file: str, seq: str) -> DataFrame:
    """One JSON text per key: its sources in rank order."""
    entry = F.struct(F.col(rank).alias("index"), F.regexp_replace(F.coalesce(F.col(file), F.lit("")), '"', "").alias("file"), F.coalesce(F.col(seq), F.lit(-1)).alias("seq"))
    return hits.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("sources"))


def newest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")
