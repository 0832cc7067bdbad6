"""Functions paired with the documentation that describes them.

A source is split into tokens, and brackets are matched in one pass. Every name before a bracket that can begin a
declaration is parsed, with the comments, annotations and types around it, by a generalised LL grammar of function
declarations in Java, Python, Go, JavaScript and TypeScript. A parameter list is one symbol of it whatever its length,
so a parse takes some tens of symbols, and a file of any length is read in proportion to its length. Recovery is part
of the grammar: a bracket or body that isn't closed is a dearer rule, and a body without an end ends before the next
function beside it; so a broken source still gives the functions that are intact. Heads with the same kinds of tokens
have the same parse, which a task remembers.

A documentation is the comment column, or else the comment before the signature or the string right behind it. Of
its lines, tags, directives, reminders, licences, separators and commented-out code say nothing; of the words left,
those of the function's name, parameters and types, and words of no content don't count. With fewer than
``CONTENT_WORDS`` others (or ``CONTENT_SIGNS`` Chinese characters) it is trivial. So is a description that, with the
function's own name taken out, stands at more than ``REPEATS`` functions of different names, at every size of the
corpus: descriptions are counted by hash over the whole of it.

Defined results: rows without ``name`` are no functions; a null signature is read from the body, a null body leaves the
rest to be read; the latest of repeated rows counts; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.gll import Grammar
from sedimenta.sources import materialize

CONTENT_WORDS, CONTENT_SIGNS = 2, 5
REPEATS = 64
REMEMBERED = 50_000

_TOKEN = re.compile(
    r"""(?P<c>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|\#[^\n]*)|(?P<s>[rRbBuUfF]{0,2}(?:\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)))"""
    r"""|(?P<q>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<n>[^\W\d][\w$]*)|(?P<k>\d[\w.]*)|(?P<x>\S)""",
)
_KEYWORDS = dict.fromkeys(("def",), "d") | dict.fromkeys(("func", "function", "fn"), "f") | dict.fromkeys("public private protected static final async abstract synchronized native default export override inline virtual const let var readonly".split(), "m")
#: Words that begin or are part of a statement: a name behind them is called, not declared.
_STATEMENT = frozenset(
    "if for while switch catch return new throw else case await yield go defer assert del in not and or is import package raise with except elif try do match select when super this typeof instanceof delete lambda from print class interface enum struct trait".split()
)

#: Of these, the words that another language takes as names.
_SOFT = frozenset("go defer select match when from print delete is del raise with package await yield assert in not and or lambda except elif typeof".split())

ANY = frozenset("csqnkdfmx()[]{}<>,:;=.*&@?|-")
HEAD_TOKENS = 64  # tokens of a head before and behind its parameter list, which counts as one


def _set(kinds: str) -> frozenset:
    return frozenset(kinds)


#: Heads of function declarations. G is a parameter list with its brackets, U one whose bracket isn't closed.
GRAMMAR = Grammar(
    "Head",
    {
        "Head": [(0, ("Lead", "Function"))],
        "Lead": [(0, ()), (0, ("Lead", "Comment")), (0, ("Lead", "Annotation")), (0, ("Lead", "Stray"))],
        "Comment": [(0, (_set("c"),))],
        "Annotation": [(0, (_set("@"), "Dotted")), (0, (_set("@"), "Dotted", "Group"))],
        "Stray": [(10, (ANY,))],
        "Function": [
            (0, ("Modifiers", _set("d"), _set("n"), "Group", "Returns", "Colon", "Doc")), (0, ("Modifiers", "Type", _set("nm"), "Group", "Throws", _set("{;"))), (5, ("Modifiers", _set("m"), "Type", _set("nm"), "Group", "Throws")), (0, (_set("f"), "Receiver", _set("n"), "Arguments", "Group", "Returns", "Open")),
            (0, ("Modifiers", "Word", _set("n"), "Group", "Returns", "Brace")), (5, ("Modifiers", _set("m"), _set("n"), "Group", "Returns")), (5, ("Modifiers", _set("f"), _set("n"), "Group", "Returns")), (0, ("Modifiers", _set("n"), _set("="), "Modifiers", "Word", "Group", "Returns", "Arrow")),
        ],
        "Word": [(0, ()), (0, (_set("f"),)), (0, (_set("*"),)), (0, (_set("f"), _set("*")))],
        "Receiver": [(0, ()), (0, ("Group",))],
        "Modifiers": [(0, ()), (0, ("Modifiers", _set("m")))],
        "Dotted": [(0, (_set("n"),)), (0, ("Dotted", _set("."), _set("n")))],
        "Type": [(0, ("Suffix",)), (0, ("Angle", "Suffix"))],
        "Suffix": [(0, ("Dotted",)), (0, ("Suffix", "Angle")), (0, ("Suffix", _set("["), _set("]")))],
        "Arguments": [(0, ()), (0, ("Angle",)), (0, (_set("["), "Listed", _set("]")))],
        "Angle": [(0, (_set("<"), "Listed", _set(">")))],
        "Listed": [(0, ()), (0, ("Listed", _set("n,.?&|[]m*"))), (0, ("Listed", "Angle"))],
        "Group": [(0, (_set("G"),)), (5, (_set("U"),))],
        "Returns": [(0, ()), (0, (_set(":"), "Result")), (0, (_set("-"), _set(">"), "Result")), (0, ("Result",))],
        "Result": [(0, ("Bare",)), (0, ("Group",))],
        "Bare": [(0, ("Bare", _set("nkqm.,<>[]*&|?s"))), (0, (_set("nkqm*[&"),))],
        "Throws": [(0, ()), (0, ("Bare",))],
        "Colon": [(0, (_set(":"),)), (5, ())],
        "Brace": [(0, (_set("{"),)), (0, ("Arrow", _set("{")))],
        "Open": [(0, (_set("{"),)), (0, (_set(";"),)), (5, ())],
        "Arrow": [(0, (_set("="), _set(">"),))],
        "Doc": [(0, (_set("sq"),)), (0.5, ())],
    },
)


class Tokens:
    """Kinds and spans of a source's tokens, and what is found about brackets and lines in one pass from either side."""

    def __init__(self, source: str):
        self.source, self.kinds, self.spans = source, [], []
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup
            if kind == "n":
                kind = "w" if m.group() in _STATEMENT else _KEYWORDS.get(m.group(), "n")
            elif kind == "x":
                kind = m.group() if m.group() in ANY else "x"
            self.kinds.append(kind)
            self.spans.append(m.span())
        n = len(self.kinds)
        self.match: list[int] = [-1] * n  # the partner of each bracket
        self.indent: list[int] = [-1] * n  # of the first token of each line
        self.first: list[int] = [0] * n  # the first token of each token's line
        open_now: dict[str, list[int]] = {"(": [], "{": []}
        ends = 0
        for i, (kind, (begin, end)) in enumerate(zip(self.kinds, self.spans)):
            line = source.rfind("\n", ends, begin)
            if line >= 0 or not i:
                self.indent[i] = begin - line - 1
            self.first[i] = i if self.indent[i] >= 0 else self.first[i - 1]
            ends = end
            if kind in open_now:
                open_now[kind].append(i)
            elif kind in ")}":
                stack = open_now["(" if kind == ")" else "{"]
                if stack:
                    self.match[i] = stack.pop()
                    self.match[self.match[i]] = i
        self.stop = [n] * (n + 1)  # where a bracket that isn't closed ends at last
        for i in range(n - 1, -1, -1):
            self.stop[i] = i if self.kinds[i] in "{;" or (self.indent[i] >= 0 and self.kinds[i] in "mdf") else self.stop[i + 1]
        below: list[int] = []
        self.outside = [n] * n  # the next line that is indented no deeper, for the first tokens of lines
        for i in range(n - 1, -1, -1):
            if self.indent[i] >= 0 and self.kinds[i] != "c":
                while below and self.indent[below[-1]] > self.indent[i]:
                    below.pop()
                self.outside[i] = below[-1] if below else n
                below.append(i)


class Heads:
    """Finds function declarations; parses of heads are remembered by their kinds of tokens."""

    def __init__(self) -> None:
        self.known: dict[str, tuple | None] = {}

    def _places(self, kinds: str) -> tuple | None:
        """Cost and token numbers: comments, first and last of the declaration, documentation string or -1."""
        if kinds not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = GRAMMAR.parse(kinds)
            comments, function, doc = [], (0, 0), -1
            todo = [found[1]] if found else []
            while todo:
                name, i, j, children = todo.pop()
                if name == "Comment":
                    comments.append(i)
                elif name == "Function":
                    function = (i, j)
                elif name == "Doc" and j > i:
                    doc = i
                todo += children
            self.known[kinds] = (found[0], tuple(sorted(comments)), function, doc) if found and found[0] < 10 else None
        return self.known[kinds]

    @staticmethod
    def _begin(t: Tokens, name: int) -> int:
        """The first token that can belong to a head with this name, or -1 where the name doesn't begin a statement."""
        at, left = name, HEAD_TOKENS
        while at > 0 and left > 0:
            before, kind = at - 1, t.kinds[at - 1]
            new_line = t.indent[at] >= 0
            if kind == "c":  # behind code it belongs to that, else to what follows
                if new_line and any(k != "c" for k in t.kinds[t.first[before] : before]):
                    break
            elif new_line:
                first = t.first[before]
                if t.kinds[first] not in "m@" or any(k not in "nm.<>[],?&@G)" for k in t.kinds[first:at]):
                    if kind in "(,=.&|?<-" or kind == "w":
                        return -1
                    break
            elif kind in ";{}":
                break
            elif kind == ")":
                before = t.match[before]
                if before < 1 or not (t.kinds[before - 1] == "f" or t.kinds[before - 1] == "n" and "@" in t.kinds[max(0, before - 8) : before]):
                    return -1
            elif kind not in "nmdf.<>[],?&@*=":
                return -1
            left -= kind != "c"
            at = before
        return at

    def find(self, source: str) -> Iterator[tuple[Tokens, str, list[int], int, int, int, int]]:
        """(tokens, name, comments, head, opening, end of the head, documentation string or -1) of each declaration, in order."""
        t = Tokens(source)
        kinds, n, behind = t.kinds, len(t.kinds), -1
        for i in range(1, n):
            if kinds[i] != "(" or i < behind:
                continue
            name = i - 1
            if kinds[name] == ">" or kinds[name] == "]":  # type parameters of the function
                depth = 0
                while name > 0 and i - name < HEAD_TOKENS:
                    depth += (kinds[name] in ">]") - (kinds[name] in "<[")
                    name -= 1
                    if not depth:
                        break
            elif kinds[name] in "mf=" and "=" in kinds[max(0, name - 2) : name + 1]:  # an arrow function has its name before the sign
                name = max(k for k in range(max(0, name - 2), name + 1) if kinds[k] == "=") - 1
            soft = name > 0 and kinds[name] == "w" and t.indent[name] < 0 and kinds[name - 1] in "nmd>]" and source[slice(*t.spans[name])] in _SOFT
            if name < 0 or not (soft or kinds[name] in "nm") or (name and (kinds[name - 1] in ".@" or kinds[name - 1] == "w")):
                continue
            if kinds[name] == "m" and source[slice(*t.spans[name])] == "synchronized":
                continue
            begin = self._begin(t, name)
            if begin < 0:
                continue
            words, numbers, at, limit = [], [], begin, 3 * HEAD_TOKENS
            while at < n and len(words) < limit:
                kind, here = kinds[at], at
                words.append("n" if here == name else kind)
                numbers.append(here)
                at += 1
                while kind == "c" and at < n and kinds[at] == "c":  # neighbouring comments are one word
                    at += 1
                if kind == "(":
                    words[-1], at = ("G", t.match[here] + 1) if t.match[here] >= 0 else ("U", max(t.stop[at], at))
                if here == i:
                    limit = len(words) + HEAD_TOKENS
                if here > i and kind in ";{":
                    break
                if here > i and kind == ":" and "d" in words:  # a documentation string is all that may follow
                    limit = len(words) + 1
                elif here > i and at < n and t.indent[at] >= 0 and kinds[at] not in "{;:=-" and kind not in ",:>-=&|":
                    break
            found = self._places("".join(words))
            if found is None:
                continue
            _, comments, (first, last), doc = found
            behind = numbers[last - 1]
            yield t, source[slice(*t.spans[name])], [k for c in comments if c < first for k in range(numbers[c], numbers[c + 1])], numbers[first], behind, behind + 1, numbers[doc] if doc >= 0 else -1

    def functions(self, source: str) -> list[dict]:
        """All functions of a source: name, documentation, signature and code."""
        found = list(self.find(source))
        starts = sorted((c[0] if c else head, t.indent[head]) for t, _, c, head, *_ in found if t.indent[head] >= 0)
        out = []
        for t, name, comments, head, opening, behind, doc in found:
            kind, own = t.kinds[opening], t.indent[t.first[head]]
            if doc >= 0 or "d" in t.kinds[head : opening + 1]:
                end = t.outside[t.first[head]]
            elif kind == "{":
                end = t.match[opening] + 1 or len(t.kinds)
            else:
                end = behind
            at = bisect.bisect_right(starts, (head, 1 << 30))
            while at < len(starts) and starts[at][0] < end:  # a body that isn't closed ends before the next function beside it
                if starts[at][1] <= own:
                    end = starts[at][0]
                    break
                at += 1
            stop = t.spans[end - 1][1]
            begin = t.spans[head][0]
            signature = source[begin : t.spans[opening][0] if kind in "{;" else t.spans[opening][1]].strip()
            code = source[begin:stop]
            if comments:
                text = "\n".join(source[slice(*t.spans[c])] for c in comments)
            elif doc >= 0:
                a, b = t.spans[doc]
                text, code = source[a:b], source[begin:a].rstrip(" \t") + source[b:stop].lstrip("\n")
                signature = source[begin:a].strip()
            else:
                text = ""
            out.append({"name": name, "doc": text, "signature": signature, "code": code})
        return out

    def read(self, source: str) -> tuple[str, str, str]:
        """(documentation, code without it, head) of the function a source opens with."""
        for t, _, comments, head, opening, _, doc in self.find(source):
            text = source[t.spans[head][0] : t.spans[opening][1]]
            if comments:
                return "\n".join(source[slice(*t.spans[c])] for c in comments), source[t.spans[head][0] :], text
            if doc >= 0:
                begin, end = t.spans[doc]
                return source[begin:end], source[:begin].rstrip(" \t") + source[end:].lstrip("\n"), source[t.spans[head][0] : begin]
            return "", source, text
        return "", source, ""


_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+|//+!?|#+!?|--+|\"{3}|'{3}|[rRuUbBfF]{1,2}(?=\"{3}|'{3})(?:\"{3}|'{3}))?\s*")
_TAIL = re.compile(r"\s*(?:\*+/|\"{3}|'{3})\s*$")
_SILENT = re.compile(
    r"^(?:(?:@|:)?(?:author|since|version|date|created|modified|email|copyright|license|licence)\b.*|(?:todo|fixme|xxx|hack|tbd|wip)\b.*"
    r"|(?:noqa|nolint|nosec|nosonar|pylint|mypy|ruff|flake8|isort|yapf|pragma|type|fmt|eslint|tslint|jshint|jslint|istanbul|prettier|noinspection|checkstyle|region|endregion|#region|#endregion|go|lint|cspell|spell-?checker|clang-format|@ts-[\w-]+)(?:$|[:\s-](?=\s*\S*$|ignore|disable|enable|next|off|on|\w+ *[:=]|all\b).*)"
    r"|(?:end)?region\b.*|noinspection\b.*|@formatter\b.*|@(?:override|suppresswarnings|deprecated|inheritdoc|generated|nullable|nonnull|test|internal|private|public|api|hide)\b\S*\s*$|\{@inheritdoc\}"
    r"|.*\bcopyright\b.*|.*\ball rights reserved\b.*|.*\bspdx-license-identifier\b.*|.*\blicensed under\b.*|.*\blicen[cs]e\b.*\b(?:terms|agreement|version|conditions)\b.*|.*\buse of this (?:file|code|software)\b.*|(?:see|see also|siehe|ver)\s+(?:above|below|oben|unten|arriba)\W*|auto-?generated\b.*|generated by\b.*|\(?non-javadoc\)?\W*|(?:no|missing) (?:description|documentation|comment|doc)s?\b\W*|(?:args|arguments|params|parameters|returns?|raises|throws|yields|notes?|examples?)\s*:?\s*$"
    r"|n\s*/?\s*a|none|无|暂无|待补充|待完善|待定|同上|略)\W*$",
    re.IGNORECASE,
)
_TAG = re.compile(r"^(?:[@\\:](?:param|arg|argument|parameter|property|prop|keyword|kwarg|type|rtype|returns?|throws?|raises?|exception|yields?)\b|[-*•]\s+)\s*(?:\{[^}]*\}\s*)?", re.IGNORECASE)
_NAMED = re.compile(r"^[@\\:](?:param|arg|argument|parameter|property|prop|keyword|kwarg|throws?|raises?|exception)\s+(?:\{[^}]*\}\s*)?[\w$.\[\]]+", re.IGNORECASE)
_GOOGLE = re.compile(r"^\*{0,2}[A-Za-z_$][\w$]*\s*(?:\([^)]*\))?\s*:(?=\s|$)")
_NUMPY = re.compile(r"^[A-Za-z_$][\w$]*\s*:\s*[A-Za-z_][\w.\[\]]*(?:\s+of\s+[\w.\[\]]+|,?\s*(?:optional|default\b.*))*\s*$")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\w.\[\]<>]+(?:\s*,\s*[\w.\[\]]+)*\s*(?:[-+*/|&]?=|:=)\s*\S|[\w\])]\.\w+\([^)]*\)\s*$|^\s*(?:return|if|for|while|elif|else|raise|throw|assert|with|try|except|catch|import|from|const|let|var|def|func|function|defer|go|select|switch|case|new|await|print)\b.*[=(\[{:;].*[)\]}:;]?\s*$|^\s*[\w.]+\([^)]*\)\s*(?:\.\w+\(.*\))*\s*[;{]?\s*$")
_HTML = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|\{@\w+\s*([^}]*)\}")
_WORDS = re.compile(r"[^\W\d_]+", re.UNICODE)
_PARTS = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-Z]?[a-zß-ÿ]+|[^\W\d_A-Za-zß-ÿ]+")
_SIGN = re.compile("[一-鿿]")
#: Words without content of their own in a documentation.
NO_CONTENT = frozenset(
    """a an the this that it its of to for in on and or is are be was with from by as at into if when which function functions method methods procedure routine helper constructor
    return returns returned returning value values result results get gets getter set sets setter given param params parameter parameters arg args argument arguments type types object objects
    int integer long str string bool boolean float double number void null none nil undefined any list map dict array self cls throws throw throwing raises raise exception exceptions error errors
    description describe documentation document documented doc docs comment see above below todo fixme add later tbd xxx auto generated stub javadoc non inherit inherited see na n optional required default
    der die das den dem ein eine einen und oder von zu fur mit gibt zuruck wert funktion methode ergebnis el la los las un una y o de del que con para por devuelve valor funcion metodo resultado""".split()
)


def _stem(word: str) -> str:
    for end in ("ing", "es", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    if len(word) > 3 and word[-1] in "eyi":
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def _parts(text: str) -> list[str]:
    return [p.lower() for w in _WORDS.findall(text) for p in _PARTS.findall(w)]


def described_lines(doc: str) -> list[str]:
    """The lines of a documentation that may say something, without marks and tags."""
    out = []
    for line in doc.splitlines():
        line = _MARK.sub("", _TAIL.sub("", line), count=1).strip()
        line = _HTML.sub(lambda m: f" {m.group(1) or ''} ", line).strip()
        if not line or _SILENT.match(line) or not any(c.isalpha() for c in line):
            continue
        bare = _TAG.sub("", _NAMED.sub("@param ", line))
        if bare == line:
            bare = _GOOGLE.sub("", line) if not _NUMPY.match(line) else ""
        bare = bare.strip()
        if bare and not _CODE.search(bare):
            out.append(bare)
    return out


def judge(name: str, signature: str, doc: str) -> tuple[str, str, int]:
    """(verdict, description, hash of the description without the function's own words)."""
    lines = described_lines(doc)
    description = " ".join(lines)
    known = {_stem(p) for p in _parts(f"{name} {signature}")}
    content, masked = set(), []
    for p in _parts(description):
        stem = _stem(p)
        own = stem in known
        masked.append("\0" if own else p)
        if not own and p not in NO_CONTENT and not _SIGN.match(p):
            content.add(stem)
    signs = len(_SIGN.findall(description))
    if not doc.strip() or not any(c.isalnum() for c in doc):
        verdict = "empty"
    else:
        verdict = "described" if len(content) >= CONTENT_WORDS or signs >= CONTENT_SIGNS else "trivial"
    return verdict, description, xxhash.xxh3_64_intdigest(" ".join(masked)) - (1 << 63)


def _read(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = Heads()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("name", "signature", "comment", "body")]
            rows = []
            for name, signature, comment, body in zip(*columns):
                given = comment and comment.strip()
                opening, code, head = heads.read(body) if body and (texts or not given or not signature) else ("", body or "", "")
                rows.append((*judge(name or "", signature or head, comment if given else opening), signature or "", code))
            verdict, description, digest, signature, code = zip(*rows) if rows else ([], [], [], [], [])
            arrays = [batch.column("unit_id"), batch.column("at"), batch.column("name"), pa.array(verdict, pa.string()), pa.array(digest, pa.int64())]
            names = ["unit_id", "at", "name", "verdict", "template"]
            if texts:
                arrays += [pa.array(x, pa.string()) for x in (description, signature, code)]
                names += ["description", "signature", "code"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _marked(judged: DataFrame) -> DataFrame:
    """Descriptions that stand at more than ``REPEATS`` differently named functions become templates.

    The hashes are counted by Spark; their list is written, so that it is broadcast only if it is measured as small.
    """
    named = judged.where("verdict = 'described'").select("template", "name").distinct()
    frequent = materialize(named.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATS).select("template", F.lit(True).alias("frequent")), "templates")
    verdict = F.when((F.col("verdict") == "described") & F.col("frequent"), "template").otherwise(F.col("verdict"))
    return judged.join(frequent, "template", "left").withColumn("verdict", verdict).drop("frequent")


def function_docs(units: DataFrame, texts: bool = True) -> DataFrame:
    """(unit_id, verdict[, description, signature, code]) of every function; verdict: described, trivial, empty or template.

    ``units``: id, method_name, signature, comment, body, created_at.
    """
    rows = units.where(F.col("method_name").isNotNull()).select(F.col("id").alias("unit_id"), F.col("created_at").alias("at"), F.col("method_name").alias("name"), "signature", "comment", "body")
    more = ["description", "signature", "code"] if texts else []
    schema = f"unit_id {units.schema['id'].dataType.simpleString()}, at {units.schema['created_at'].dataType.simpleString()}, name string, verdict string, template long" + "".join(f", {c} string" for c in more)
    judged = materialize(rows.mapInArrow(_read(texts), schema).withColumn("row", F.monotonically_increasing_id()), "judged")
    # rows that another of their unit replaces: found without their texts, and few, so that the texts needn't be shuffled
    latest = Window.partitionBy("unit_id").orderBy(F.col("at").desc(), F.col("verdict").desc(), F.col("template").desc(), "row")
    replaced = judged.select("unit_id", "at", "verdict", "template", "row").withColumn("n", F.row_number().over(latest)).where("n > 1").select("row")
    once = judged.join(materialize(replaced, "replaced"), "row", "left_anti")
    return _marked(once).select("unit_id", "verdict", *more)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads = Heads()
    for batch in batches:
        rows = []
        for key, source in zip(batch.column("key").to_pylist(), batch.column("source").to_pylist()):
            for n, f in enumerate(heads.functions(source)):
                verdict, description, digest = judge(f["name"], f["signature"], f["doc"])
                rows.append((key, n, f["name"], verdict, digest, description, f["signature"], f["code"]))
        columns = zip(*rows) if rows else [[]] * 8
        kinds = (batch.column("key").type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n", "name", "verdict", "template", "description", "signature", "code"])


def functions_in_sources(sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, n, name, verdict, description, signature, code): every function or method of whole source files, in order,
    those in classes and in broken files included; texts that are no code give none, null and empty ones neither."""
    kind = sources.schema[key].dataType.simpleString()
    rows = sources.where(F.length(source) > 0).select(F.col(key).alias("key"), F.col(source).alias("source"))
    found = rows.mapInArrow(_found, f"key {kind}, n int, name string, verdict string, template long, description string, signature string, code string")
    return _marked(materialize(found, "functions")).drop("template").withColumnRenamed("key", key).select(key, "n", "name", "verdict", "description", "signature", "code")
