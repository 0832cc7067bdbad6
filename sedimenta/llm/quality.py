"""Text quality statistics of documents, and whether a document is natural prose.

A text of more than ``CHUNK`` characters is cut into chunks, so one huge document is the work of many tasks. Each chunk
gives partial counts that add up, and the state at its two ends: the word and the line that may go on in the
neighbour. Chunks of a document are merged in order, ``FAN_IN`` at a time, level by level; where a word or line
crosses the border its two halves are taken back and the whole is counted. Ratios and verdicts come from the sums.

Statistics. A word is one Chinese character or a run of other letters, digits and underscores. Symbols are
characters that are neither letters, digits, underscores nor white space. A line is a non-blank stretch between line
ends; it ends in punctuation if its last visible character is one of ``ENDS``. Common words are those of ``COMMON``.

Prose. A line counts as running text if its words look like sentences: enough function words of English, German or
Spanish, or Chinese function characters, few symbols, few single letters, no code. Comments don't count in a document
that has code anywhere, nor do word sequences that the document has had before, and if articles are missing among the
function words the words are scrambled. A document whose running text is less than half of its visible characters is no
prose. Chunks don't change a verdict: they are cut between lines, a line of more than ``LINE`` characters is judged in
stretches of ``LINE`` wherever it stands, a chunk is told which comment it begins in, counts within comments are kept
apart until it is known whether there is code, and the sequences of a long document are made distinct by Spark over all
its chunks.

Defined results: null, empty and blank texts have no words and lines, null ratios, and are no prose; every row of the
input gives a row, repeated ids too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.words import WORD, WordHashes
from sedimenta.sources import materialize

CHUNK, FAN_IN = 1 << 16, 32
LINE = 1 << 13
SEQUENCE = 8
LONGEST_COMMON = 16
ENDS = frozenset(".!?。！？…")

#: Articles and other function words of English, German and Spanish; function characters of Chinese.
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer el la los las un una".split())
FUNCTION = ARTICLES | frozenset(
    """of and to in is that it for on was with as by be at this have from or had not but what all were we when can there which their if will each has no so would they she he her his you your our my me i
    before after while because since until without between every more than then only into about where who how both neither nor yet too does did do been being may might must should could its it's us one again out over
    und oder nicht ist sind war wird werden wenn weil dass aber auch auf mit von zu zum zur im in am an bei nach vor aus für wie wer was wo noch nur schon sich es er sie wir ihr ihn ihm kein keine kann lässt hat haben bis ob damit denn sodass obwohl warum niemand jeder jede jeden unter über
    y o de del que en con por para se su sus lo al como más pero si no es son fue era ha han cuando porque sin sobre entre ya ni nadie cada este esta esto ese esa hay muy también todavía antes después quién""".split()
)
CHINESE = frozenset("在了是把被请都会就先才但也因为如果我们这里之后此去没每只那什么其实而已并由想应当看于它来得时候做有不一个")
COMMON = FUNCTION | CHINESE
_DANGLING = re.compile(r"\b(?:the|an?|of|to|and|from|or|with|for|at|by|as|was|were|when|der|die|das|den|dem|und|von|mit|el|la|los|las|y|de|en|con|por)[.!?,;](?=\s|$)")

_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_STRAY = re.compile(r"[#$%&*+/<=>@\[\\\]^{|}~]")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|\w+://\S+")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:def|class|func|function|async|return|raise|assert|import|from\s+\S+\s+import|public|private|protected|static|const|let|var|if\s*\(|for\s*\(|while\s*\(|elif|else:|try:|except|with\s.+:$|logger\.|log\.|console\.)\b.*[({:;=\[]"
    r"|\w\.\w+\([^)]*\)[;,)]?\s*$|^\s*[\w.\[\], ]+\s*(?::=|\+=|=)\s*\S.*[\w)\]]\s*$|:=|=>|->|==|\(\)\s*\{|^\s+at\s+[\w.$]+\("
)

#: What is counted of running lines, once outside of comments and once (``in_``) within them.
PROSE = ("running", "sequences", "distinct", "functions", "articles", "dangling")
COUNTS = ("n_chars", "n_words", "n_word_chars", "n_symbols", "n_lines", "n_ended", "n_common", "visible", "code", *PROSE, *(f"in_{c}" for c in PROSE))
STATE = {"head": "string", "head_size": "long", "tail": "string", "tail_size": "long", "one_word": "boolean", "first": "string", "last": "string", "one_line": "boolean"}
SCHEMA = "row long, part int, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} {kind}" for c, kind in STATE.items())


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def _running(line: str, words: list[str]) -> list[str] | None:
    """The words of a line that looks like sentences."""
    if len(words) < 4:
        return None
    if "<" in line or "://" in line:
        line = _TAGS.sub(" ", line)
        words = WORD.findall(line)
    chinese = 0 if line.isascii() else sum(1 for w in words if len(w) == 1 and "一" <= w <= "鿿")
    if 2 * chinese > len(words):
        if chinese < 8 or sum(map(CHINESE.__contains__, words)) < 0.12 * chinese:
            return None
    else:
        latin = len(words) - chinese
        if latin < 4 or sum(map(FUNCTION.__contains__, words)) < 0.2 * latin or sum(1 for w in words if len(w) == 1) - chinese > 0.3 * latin:
            return None
    if len(_STRAY.findall(line)) > (0.16 if chinese else 0.08) * len(line) or _CODE.search(line):
        return None
    return words


def _stretches(text: str) -> list[str]:
    """The lines of a text, those of more than ``LINE`` characters in stretches of it."""
    return [line[k : k + LINE] for line in _LINE.split(text) for k in range(0, max(len(line), 1), LINE)]


def comment_after(line: str, comment: str | None) -> tuple[bool, str | None]:
    """Whether a line stands in a comment, and what ends the comment that is open behind it."""
    text = line.lstrip()
    if comment:
        return True, None if comment in text else comment
    if text[:1] in "/\"'#-":
        if text.startswith("/*"):
            return True, None if "*/" in text[2:] else "*/"
        if text.startswith(('"""', "'" * 3)):
            return True, None if text[:3] in text[3:] else text[:3]
        if text.startswith(("//", "#", "--")):
            return True, None
    return False, None


def _sequences(lines: list[list[str]], memory: WordHashes) -> tuple[int, np.ndarray]:
    """How many sequences of ``SEQUENCE`` words the lines have (a shorter line is one), and their distinct hashes."""
    if not lines:
        return 0, np.empty(0, dtype=np.uint64)
    flat: list[str] = []
    ends = []
    for x in lines:
        flat += x
        if len(x) < SEQUENCE:
            flat += [""] * (SEQUENCE - len(x))
        ends.append(len(flat))
    codes, ends = np.fromiter(map(memory.__getitem__, flat), dtype=np.uint64, count=len(flat)), np.array(ends)
    n = len(codes) - SEQUENCE + 1
    value = np.zeros(n, dtype=np.uint64)
    for k in range(SEQUENCE):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    inside = np.ones(n, dtype=bool)
    for k in range(1, SEQUENCE):
        at = ends[:-1] - k
        inside[at[at < n]] = False
    value = value[inside]
    return len(value), np.unique(value)


def _prose_counts(lines: list[str], words_of: list[list[str]], memory: WordHashes, comment: str | None, sure: bool) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """Counts of running lines and the hashes of their sequences. ``sure``: look for code even without comments."""
    kept: dict[str, list[list[str]]] = {"": [], "in_": []}
    out = dict.fromkeys((*PROSE, *(f"in_{c}" for c in PROSE)), 0)
    for line, words in zip(lines, words_of):
        inside, comment = comment_after(line, comment)
        own = _running(line, words)
        if own is None:
            continue
        where = "in_" if inside else ""
        out[f"{where}running"] += _visible(line)
        out[f"{where}functions"] += sum(map(FUNCTION.__contains__, own))
        after = [own[k + 1 : k + 2] for k, w in enumerate(own) if w in ARTICLES]
        out[f"{where}articles"] += len(after)
        out[f"{where}dangling"] += sum(1 for w in after if w and w[0] in FUNCTION) + len(_DANGLING.findall(line))
        kept[where].append(own)
    hashes = {}
    for where, own in kept.items():
        out[f"{where}sequences"], hashes[where] = _sequences(own, memory)
        out[f"{where}distinct"] = len(hashes[where])
    out["code"] = int((sure or bool(kept["in_"])) and any(map(_CODE.search, lines)))
    return out, hashes


def _is_word(c: str) -> bool:
    return (c.isalnum() or c == "_") and not "一" <= c <= "鿿"


def _last_visible(line: str) -> str:
    return line.rstrip()[-1:]


def measure(raw: str, memory: WordHashes, comment: str | None = None, sure: bool = False) -> tuple[dict, dict[str, np.ndarray]]:
    """Partial counts of a chunk with the state at its ends, and the hashes of its word sequences."""
    text = raw.lower()
    lines = _LINE.split(text)
    filled = [x for x in lines if x and not x.isspace()]
    words_of = [WORD.findall(x) for x in filled]
    words = [w for own in words_of for w in own]
    visible, in_words = _visible(text), sum(map(len, words))  # what is visible and in no word is a symbol
    out = {
        "n_chars": len(raw), "n_words": len(words), "n_word_chars": in_words, "n_symbols": visible - in_words, "n_lines": len(filled),
        "n_ended": sum(_last_visible(x) in ENDS for x in filled), "n_common": sum(map(COMMON.__contains__, words)), "visible": visible,
    }
    stretches = filled
    if len(raw) > LINE and max(map(len, _LINE.split(raw))) > LINE:
        stretches = [x.lower() for x in _stretches(raw) if x and not x.isspace()]
        words_of = [WORD.findall(x) for x in stretches]
    counts, hashes = _prose_counts(stretches, words_of, memory, comment, sure)
    out |= counts
    head = words[0] if words and text and _is_word(text[0]) else ""
    tail = words[-1] if words and _is_word(text[-1]) else ""
    keep = LONGEST_COMMON + 1
    out |= {"head": head[:keep], "head_size": len(head), "tail": tail[:keep], "tail_size": len(tail), "one_word": len(words) == 1 and len(head) == len(text)}
    return out | {"first": _last_visible(lines[0]), "last": _last_visible(lines[-1]), "one_line": len(lines) == 1}, hashes


def cut(text: str, chunk: int = CHUNK) -> list[tuple[str, str | None]]:
    """A text in chunks of about ``chunk`` characters, each with what ends the comment it begins in."""
    out, begin, held, comment, entered = [], 0, 0, None, None
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    for start, end in zip(starts, [*starts[1:], len(text)]):
        line = _LINE.split(text[start:end], 1)[0]
        for k in range(0, max(len(line), 1), LINE):
            at = start + k
            if at > begin and min(at + LINE, end) - begin > chunk:
                out.append((text[begin:at], entered))
                begin, entered = at, comment
            stretch = line[k : k + LINE]
            if stretch and not stretch.isspace():
                _, comment = comment_after(stretch, comment)
    return [*out, (text[begin:], entered)]


def merge(a: dict, b: dict) -> dict:
    """Counts and state of two neighbouring stretches of a text."""
    out = {c: a[c] + b[c] for c in COUNTS}
    keep = LONGEST_COMMON + 1
    word, size = "", 0
    if a["tail_size"] and b["head_size"]:
        word, size = (a["tail"] + b["head"])[:keep], a["tail_size"] + b["head_size"]
        out["n_words"] -= 1
        out["n_common"] += (word in COMMON) - (a["tail"] in COMMON) - (b["head"] in COMMON)
    out["head"], out["head_size"] = (word, size) if a["one_word"] and size else (a["head"], a["head_size"])
    out["tail"], out["tail_size"] = (word, size) if b["one_word"] and size else (b["tail"], b["tail_size"])
    out["one_word"] = bool(a["one_word"] and b["one_word"])
    joined = b["first"] or a["last"]
    out["n_lines"] += bool(joined) - bool(a["last"]) - bool(b["first"])
    out["n_ended"] += sum(sign * (c in ENDS and c != "") for sign, c in ((1, joined), (-1, a["last"]), (-1, b["first"])))
    out["first"] = joined if a["one_line"] else a["first"]
    out["last"] = joined if b["one_line"] else b["last"]
    out["one_line"] = bool(a["one_line"] and b["one_line"])
    return out


def _columns(found: list[dict]) -> list[pa.Array]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return [pa.array([x.get(c) for x in found], kinds[STATE.get(c, "long")]) for c in (*COUNTS, *STATE)]


def _measured(chunk: int):
    """Rows measured at once, or cut into chunks where they are long: those have a text and no counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            at, parts, found, texts, comments = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                pieces = cut(text, chunk) if text and len(text) > chunk else []
                at += [i] * max(len(pieces), 1)
                parts += range(max(len(pieces), 1))
                found += [{} for _ in pieces] or [measure(text or "", memory)[0]]
                texts += [p for p, _ in pieces] or [None]
                comments += [c for _, c in pieces] or [None]
            own = pa.array(at, pa.int64())
            arrays = [batch.column("key").take(own), batch.column("row").take(own), pa.array(parts, pa.int32()), *_columns(found), pa.array(texts, pa.string()), pa.array(comments, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "row", "part", *COUNTS, *STATE, "text", "comment"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = WordHashes()
    for batch in batches:
        found = [measure(t, memory, c, sure=True) for t, c in zip(batch.column("text").to_pylist(), batch.column("comment").to_pylist())]
        hashes = [pa.array([h[where].view(np.int64) for _, h in found], pa.list_(pa.int64())) for where in ("", "in_")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), batch.column("part"), *_columns([x for x, _ in found]), *hashes], ["key", "row", "part", *COUNTS, *STATE, "hashes", "in_hashes"])


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    found = rows.sort_values("part").to_dict("records")
    whole = found[0]
    for piece in found[1:]:
        whole = merge(whole, piece)
    return pd.DataFrame([whole | {"key": found[0]["key"], "row": found[0]["row"], "part": found[0]["part"] // FAN_IN}])[list(rows.columns)]


def _long(pieces: DataFrame, schema: str) -> DataFrame:
    """Counts of the documents that were cut: chunks spread over tasks, merged in order, sequences distinct by document."""
    chunks = materialize(pieces.repartition("row", "part").mapInArrow(_chunks, f"{schema}, hashes array<long>, in_hashes array<long>"), "chunks")
    whole = chunks.drop("hashes", "in_hashes")
    for _ in range(3):  # FAN_IN^3 chunks are more than a string can hold
        whole = whole.groupBy("row", F.floor(F.col("part") / FAN_IN).alias("block")).applyInPandas(_fold, schema)
    each = chunks.select("row", F.explode("hashes").alias("h"), F.lit(0).alias("inside")).unionByName(chunks.select("row", F.explode("in_hashes").alias("h"), F.lit(1).alias("inside")))
    distinct = each.distinct().groupBy(F.col("row").alias("of")).agg(F.count_if(F.col("inside") == 0).alias("fresh"), F.count_if(F.col("inside") == 1).alias("in_fresh"))
    joined = whole.join(distinct, F.col("row") == F.col("of"), "left")
    return joined.withColumns({"distinct": F.coalesce("fresh", F.lit(0)), "in_distinct": F.coalesce("in_fresh", F.lit(0))}).select(*whole.columns)


def quality(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """One row a row: ``key``, the statistics, the share of running text, and whether the document is prose."""
    schema = f"key {df.schema[key].dataType.simpleString()}, {SCHEMA}"
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    first = materialize(rows.mapInArrow(_measured(chunk), f"{schema}, text string, comment string"), "measured")  # the one scan of the texts
    counts = first.where("text IS NULL").drop("text", "comment").unionByName(_long(first.where("text IS NOT NULL").select("key", "row", "part", "text", "comment"), schema))
    for c in PROSE:  # comments count where there is no code
        counts = counts.withColumn(c, F.col(c) + F.when(F.col("code") == 0, F.col(f"in_{c}")).otherwise(F.lit(0)))
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    fresh = F.when(F.col("sequences") > 0, F.col("distinct") / F.col("sequences")).otherwise(F.lit(1.0))
    # log odds of ordered against scrambled words: articles are 28 % of the function words of a text, 5 % of a scramble
    odds = 2 + F.col("articles") * 1.72 - (F.col("functions") - F.col("articles")) * 0.277 - F.col("dangling") * 2
    share = F.when((F.col("visible") == 0) | (odds < 0), 0.0).otherwise(F.col("running") * fresh / F.col("visible"))
    return counts.select(
        F.col("key").alias(key), "n_chars", "n_words", (F.col("n_word_chars") / words).alias("mean_word_length"), (F.col("n_symbols") / F.nullif(F.col("n_chars"), F.lit(0))).alias("symbol_ratio"),
        "n_lines", (F.col("n_ended") / lines).alias("ended_share"), (F.col("n_common") / words).alias("common_share"), share.alias("running_share"), (share >= 0.5).alias("prose"),
    )
