"""Concept notes: rows to files of front matter and body, and files back to rows.

Rows become text by one expression that follows their schema: structs are maps, arrays are sequences. Files become rows by
a grammar of indentation, read with a stack of open maps and sequences by an Arrow function; the front matter comes
back as JSON, which ``typed`` reads with a schema and ``try_parse_json`` as VARIANT.
"""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampType

# Fixed values of the file format: maps written on one line, keys whose texts are always quoted or never, and words that plain text can't be.
FLOW_KEYS = ("generated", "verified")
QUOTED_KEYS = ("pmid", "doi", "pmcid", "volume", "issue", "pages", "issn", "sha256", "zip", "issn_linking")
PLAIN_KEYS = ("at", "publication_date", "epub_date", "stale_after", "accessed_at", "created_at", "updated_at", "executed_at")
RESERVED = ("null", "~", "true", "false", "yes", "no", "on", "off", "True", "False", "Null", "NULL", "TRUE", "FALSE")
PLAIN = r"^[A-Za-z0-9][A-Za-z0-9_.:+/-]*\z"
NUMBER = r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"
DATE = r"\d{4}-\d{2}-\d{2}"
LEAD = "-?:,[]{}#&*!|>'\"%@`"

_CLASS = "[" + "".join("\\" + c for c in LEAD) + "]"
#: Texts that are quoted: empty, with white space at an end, read as another type, with a sign in front, or with a break or a mark inside.
_UNSAFE = "|".join(
    [r"\A\z", r"(?U)\A\s|\s\z", r"\A(?:" + "|".join(re.escape(x) for x in RESERVED) + r"|" + NUMBER + "|" + DATE + r")\z", r"\A" + _CLASS, r"[\x00-\x1f\x7f-\x9f  ]", r": | #|:\z"]
)
#: Texts that plain would come back as a null, a truth value or another number.
_LOSSY = r"\A(?:" + "|".join(re.escape(x) for x in RESERVED) + r")\z|\A(?!(?:0|[1-9]\d{0,17})\z)" + NUMBER + r"\z"
_FRONT = r"(?s)\A---[ \t]*\n(.*?)(?<=\n)[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z)"

# ---------------------------------------------------------------- rows to files


def _quoted(s: Column) -> Column:
    """A text between double quotes, with escapes."""
    said = functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")], s)
    others = [(chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in "\n\t"]
    rare = functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), others, said)
    return F.concat(F.lit('"'), F.when(said.rlike(r"[\x00-\x1f]"), rare).otherwise(said), F.lit('"'))


def _scalar(x: Column, kind: DataType, key: str | None, flow: bool) -> Column:
    """A value in the file's form; null where it is null."""
    if isinstance(kind, TimestampType):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(kind, (BooleanType, NumericType, DateType)):
        return x.cast("string")
    if not isinstance(kind, StringType):
        raise ValueError(f"no scalar of a note: {kind.simpleString()}")
    if key in QUOTED_KEYS:
        return _quoted(x)
    unsafe = x.rlike(_UNSAFE + (r"|[,\[\]{}]" if flow else ""))
    if key in PLAIN_KEYS:  # plain unless another text would be read
        unsafe = unsafe & (~x.rlike(PLAIN) | x.rlike(_LOSSY))
    return F.when(unsafe, _quoted(x)).otherwise(x)


def _is_scalar(kind: DataType) -> bool:
    return not isinstance(kind, (StructType, ArrayType, MapType))


def _name(key: str) -> str:
    return key if re.match(PLAIN.replace(r"\z", r"\Z"), key) else json.dumps(key)


def _field(x: Column, kind: DataType, key: str, indent: int) -> Column:
    """Lines of one entry of a map; null where the value is null, so absent and null are one."""
    space, name = " " * indent, _name(key)
    head = F.lit(f"{space}{name}:")
    if isinstance(kind, StructType):
        if key in FLOW_KEYS and all(_is_scalar(f.dataType) for f in kind):
            inner = F.concat_ws(", ", *[F.concat(F.lit(f"{_name(f.name)}: "), _scalar(x[f.name], f.dataType, f.name, True)) for f in kind])
            said = F.when(inner == "", F.lit(" {}")).otherwise(F.concat(F.lit(" { "), inner, F.lit(" }")))
        else:
            inner = _map(x, kind, indent + 2)
            said = F.when(inner == "", F.lit(" {}")).otherwise(F.concat(F.lit("\n"), inner))
    elif isinstance(kind, MapType):
        if not (isinstance(kind.keyType, StringType) and _is_scalar(kind.valueType)):
            raise ValueError("maps of a note have text keys and plain values")

        def entry(e: Column) -> Column:
            k = F.when(e["key"].rlike(PLAIN), e["key"]).otherwise(_quoted(e["key"]))
            return F.concat(F.lit(" " * (indent + 2)), k, F.lit(": "), F.coalesce(_scalar(e["value"], kind.valueType, None, False), F.lit("null")))

        inner = F.array_join(F.transform(F.array_sort(F.map_entries(x)), entry), "\n")
        said = F.when(inner == "", F.lit(" {}")).otherwise(F.concat(F.lit("\n"), inner))
    elif isinstance(kind, ArrayType) and _is_scalar(kind.elementType):
        said = F.concat(F.lit(" ["), F.array_join(F.transform(x, lambda v: F.coalesce(_scalar(v, kind.elementType, key, True), F.lit("null"))), ", "), F.lit("]"))
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        dash = " " * (indent + 2) + "- "

        def item(v: Column) -> Column:
            inner = _map(v, kind.elementType, indent + 4)
            return F.concat(F.lit(dash), F.when(F.coalesce(inner, F.lit("")) == "", F.lit("{}")).otherwise(F.substr(inner, F.lit(indent + 5))))

        said = F.when(F.size(x) == 0, F.lit(" []")).otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(x, item), "\n")))
    elif _is_scalar(kind):
        said = F.concat(F.lit(" "), _scalar(x, kind, key, False))
    else:
        raise ValueError(f"no value of a note: {kind.simpleString()}")
    return F.when(x.isNotNull(), F.concat(head, said))


def _map(x: Column, kind: StructType, indent: int) -> Column:
    return F.when(x.isNotNull(), F.concat_ws("\n", *[_field(x[f.name], f.dataType, f.name, indent) for f in kind]))


def front_matter(front: Column, kind: StructType) -> Column:
    """Front matter of a struct column, a line or more for each field that is not null, in the order of the schema."""
    inner = _map(front, kind, 0)
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit("")).otherwise(F.concat(inner, F.lit("\n")))


def to_files(notes: DataFrame, *, front: str = "front", body: str = "body") -> DataFrame:
    """Notes (folder, slug, a struct of front matter, body) as files: ``path, text``.

    Null fields are left out, and with them null structs, maps and arrays; empty ones are written. Line breaks
    around the body are not kept; a null body is empty. A null folder or slug is an error of the row: its path is null.
    """
    kind = notes.schema[front].dataType
    inner = F.regexp_replace(F.coalesce(body, F.lit("")), r"\A\n+|\n+\z", "")
    text = F.concat(F.lit("---\n"), front_matter(F.col(front), kind), F.lit("---\n\n"), inner, F.lit("\n"))
    return notes.select(F.concat(F.col("folder"), F.lit("/"), F.col("slug"), F.lit(".md")).alias("path"), text.alias("text"))


# ---------------------------------------------------------------- files to rows

_TOKEN = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|([\[\]{},])|((?:[^"'\[\]{},])+)|(.)""", re.S)
_CODE = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?<![ \t])(?<!^)#|[^"'#])*""", re.S)
_STRING = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*""", re.S)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_WORDS = {"null": None, "~": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def _unquoted(s: str) -> str:
    if s[0] == "'":
        return s[1:-1].replace("''", "'")
    said = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _NAMED.get(m[1], m[1]), s[1:-1])
    # Two escapes may stand for one character; half of one is no character.
    return said.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", said) else said


def _code(line: str) -> str:
    """A line without its comment. A quote that no other ends is a mark like any."""
    found = _CODE.match(line)[0]
    return (line if found != line and line[len(found)] in "\"'" else found).rstrip()


def _entry(s: str) -> tuple[str, str] | None:
    """Key and rest of ``key: rest``; None if it is no entry of a map."""
    if s[:1] in ('"', "'"):
        m = _STRING.match(s)
        return (_unquoted(m[1]), s[m.end() + 1 :].strip()) if m and s[m.end() : m.end() + 1] == ":" else None
    m = re.search(r":(?=[ \t]|\Z)", s)
    return (s[: m.start()].strip(), s[m.end() :].strip()) if m else None


def _parts(s: str) -> list[str]:
    """Parts of a flow sequence or map between commas outside of quotes and brackets."""
    out, depth, now = [], 0, ""
    for m in _TOKEN.finditer(s):
        if m[2] == "," and depth == 0:
            out.append(now.strip())
            now = ""
            continue
        depth += (m[2] in ("[", "{")) - (m[2] in ("]", "}")) if m[2] else 0
        now += m[0]
    return [*out, now.strip()] if now.strip() else out


def _value(s: str):
    if s[0] in "\"'":
        m = _STRING.fullmatch(s)
        if not m:
            raise ValueError("text around a quoted value")
        return _unquoted(m[1])
    if s[0] in "[{":
        if s[-1] != {"[": "]", "{": "}"}[s[0]]:
            raise ValueError("open bracket")
        parts = _parts(s[1:-1])
        if s[0] == "[":
            return [_value(p) if p else None for p in parts]
        pairs = [_entry(p) for p in parts if p]
        if None in pairs:
            raise ValueError("no entry of a map")
        return {k: _value(v) if v else None for k, v in pairs}
    if s in _WORDS:
        return _WORDS[s]
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    return float(s) if re.fullmatch(NUMBER, s) else s


def parse_front(text: str) -> dict:
    """The map that front matter states. A stack holds what is open, each with its indentation; a line closes what lies deeper."""
    root: dict = {}
    open_: list[tuple[int, dict | list]] = []
    slot: tuple[int, dict | list, str | int] | None = None  # a key or item whose value stands on the next lines
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        raw = lines[at].rstrip("\r")
        at += 1
        bare = raw.lstrip(" ")
        code = "" if bare.startswith("#") else _code(bare)
        if not code:
            continue
        indent, item = len(raw) - len(bare), code == "-" or code.startswith("- ")
        if not open_:
            open_.append((indent, root))
        elif slot and (indent > slot[0] or (item and indent == slot[0] and isinstance(slot[1], dict))):
            slot[1][slot[2]] = node = [] if item else {}
            open_.append((indent, node))
        else:
            while open_ and (open_[-1][0] > indent or (open_[-1][0] == indent and isinstance(open_[-1][1], list) != item)):
                open_.pop()
        slot = None
        if not open_ or open_[-1][0] != indent or isinstance(open_[-1][1], list) != item:
            raise ValueError(f"indentation of line {at}")
        node = open_[-1][1]
        if item:
            rest = code[1:].lstrip(" ")
            node.append(None)
            pair = _entry(rest) if rest else None
            if not rest:
                slot = (indent, node, len(node) - 1)
                continue
            if pair is None:
                node[-1] = _value(rest)
                continue
            indent += len(code) - len(rest)
            node[-1] = node = {}
            open_.append((indent, node))
        else:
            pair = _entry(code)
            if pair is None:
                raise ValueError(f"no entry of a map in line {at}")
        key, rest = pair
        node[key] = None
        if not rest:
            slot = (indent, node, key)
        elif rest in ("|", ">", "|-", ">-"):
            block = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > indent):
                block.append(lines[at])
                at += 1
            deep = min((len(x) - len(x.lstrip(" ")) for x in block if x.strip()), default=0)
            said = "\n".join(x[deep:] for x in block).strip("\n")
            node[key] = (re.sub(r"(?<!\n)\n(?!\n)", " ", said) if rest[0] == ">" else said) + ("" if rest.endswith("-") else "\n")
        else:
            node[key] = _value(rest)
    return root


@F.pandas_udf(StructType().add("front", "string").add("error", "string"))
def _parsed(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        try:
            out.append((None if text is None else json.dumps(parse_front(text), ensure_ascii=False), None))
        except ValueError as wrong:
            out.append((None, str(wrong)))
    return pd.DataFrame(out, columns=["front", "error"])


def from_files(files: DataFrame) -> DataFrame:
    """Files (path, text) as notes: ``path, folder, slug, front, body, error``, the front matter as JSON.

    A file without front matter has a null front and all its text as body. Front matter that breaks the grammar has a null front
    and an error; what follows a wrong line is never left out in silence. Line breaks around the body are dropped. A null text
    is an empty file; a path without a folder has an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    found = files.select("path", text.alias("text"), F.regexp_extract(text, _FRONT, 0).alias("_head"), F.regexp_extract(text, _FRONT, 1).alias("_front"))
    has = F.col("_head") != ""
    rest = F.when(has, F.substr("text", F.length("_head") + 1)).otherwise(F.col("text"))
    found = found.select("path", F.when(has, F.col("_front")).alias("_front"), F.regexp_replace(rest, r"\A\n+|\n+\z", "").alias("body"))
    parts = F.split("path", "/")
    return found.withColumn("_x", _parsed("_front")).select(
        "path", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.md\z", "").alias("slug"), F.col("_x.front").alias("front"), "body", F.col("_x.error").alias("error")
    )


def typed(notes: DataFrame, kind: StructType | str) -> DataFrame:
    """Notes with the fields of their front matter as columns; numbers and dates where the schema says text come as text."""
    return notes.withColumn("_f", F.from_json("front", kind)).select("path", "folder", "slug", "body", "error", "_f.*")
