"""Header lines and the catalog of a file's references and read groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.flags import FormatError

HEADER_TYPE = "struct<type:string,fields:array<struct<tag:string,value:string>>>"


@dataclass
class Header:
    """One line: a type and its fields, in order; the first of a tag counts."""

    type: str
    fields: list[tuple[str, str]] = field(default_factory=list)
    comment: str | None = None

    @classmethod
    def parse(cls, line: str) -> Header:
        if len(line) < 3 or line[0] != "@" or (len(line) > 3 and line[3] != "\t"):
            raise FormatError(f"not a header line: {line!r}")
        kind, rest = line[1:3], line[4:]
        if kind == "CO":
            return cls(kind, comment=rest)
        out = cls(kind)
        for part in rest.split("\t") if rest else []:
            if len(part) < 3 or part[2] != ":":
                raise FormatError(f"not a header field: {part!r}")
            out.fields.append((part[:2], part[3:]))
        return out

    def __str__(self) -> str:
        parts = [self.comment] if self.comment is not None else [f"{k}:{v}" for k, v in self.fields]
        return "\t".join([f"@{self.type}", *parts])

    def get(self, tag: str, default: str | None = None) -> str:
        for k, v in self.fields:
            if k == tag:
                return v
        if default is None:
            raise FormatError(f"header field {tag!r} not found in {self}")
        return default

    def get_int(self, tag: str, default: int | None = None) -> int:
        text = self.get(tag, None if default is None else str(default))
        try:
            return int(text)
        except ValueError as e:
            raise FormatError(f"header field {tag!r} is not a number: {text!r}") from e

    def set(self, tag: str, value: str) -> None:
        for i, (k, _) in enumerate(self.fields):
            if k == tag:
                self.fields[i] = (tag, value)
                return
        self.fields.append((tag, value))

    def push_back(self, tag: str, value: str) -> None:
        self.fields.append((tag, value))

    def insert(self, at: int, tag: str, value: str) -> None:
        self.fields.insert(at, (tag, value))

    def replace(self, at: int, tag: str, value: str) -> None:
        self.fields[at] = (tag, value)

    def clear(self) -> None:
        self.fields = []

    def erase(self, tag: str) -> int:
        kept = [f for f in self.fields if f[0] != tag]
        n, self.fields = len(self.fields) - len(kept), kept
        return n


class HeaderCatalog:
    """All header lines of a file, its references by index and name, its read groups."""

    def __init__(self, lines: list[str] | None = None, references: list[tuple[str, int]] | None = None):
        self.headers = [Header.parse(x) for x in lines or []]
        named = [(h.get("SN"), h.get_int("LN", 0)) for h in self.headers if h.type == "SQ"]
        if references is not None and named and [n for n, _ in references] != [n for n, _ in named]:
            known = dict(named)
            for name, _ in references:
                if name not in known:
                    raise FormatError(f"reference {name!r} is not in the text header")
            named = [(n, length) for n, length in references]
        self.references: list[tuple[str, int]] = named or list(references or [])
        self.index = {n: i for i, (n, _) in enumerate(self.references)}
        if len(self.index) != len(self.references):
            raise FormatError("a reference name occurs twice")

    @property
    def groups(self) -> dict[str, Header]:
        """Read groups by id; the last of an id counts."""
        return {h.get("ID"): h for h in self.headers if h.type == "RG"}

    @property
    def first_groups(self) -> dict[str, Header]:
        """Read groups by id; the first of an id counts, as in splitting."""
        out: dict[str, Header] = {}
        for h in self.of_type("RG"):
            out.setdefault(h.get("ID"), h)
        return out

    def push_back(self, line: str) -> None:
        self._replace([*self.headers, Header.parse(line)])

    def insert(self, at: int, line: str) -> None:
        self._replace([*self.headers[:at], Header.parse(line), *self.headers[at:]])

    def replace(self, at: int, line: str) -> None:
        self._replace([*self.headers[:at], Header.parse(line), *self.headers[at + 1 :]])

    def clear(self) -> None:
        self._replace([])

    def _replace(self, headers: list[Header]) -> None:
        """Other lines; references and groups follow them, or nothing changes."""
        own = HeaderCatalog([str(h) for h in headers])
        self.headers, self.references, self.index = headers, own.references, own.index

    def set_reference(self, key: str | int, **fields: str | int) -> None:
        """New fields of a reference's line, e.g. SN, LN, SP, AS, UR, M5."""
        name = self.find_reference(key)[0]
        line = next(h for h in self.of_type("SQ") if h.get("SN") == name)
        for tag, value in fields.items():
            line.set(tag, str(value))
        self._replace(self.headers)

    def find_reference(self, key: str | int) -> tuple[str, int]:
        """(name, length) by name or index; ``*`` and -1 are no reference."""
        if key in ("*", -1):
            return "*", 0
        if isinstance(key, int) and 0 <= key < len(self.references):
            return self.references[key]
        if key in self.index:
            return self.references[self.index[key]]
        raise KeyError(f"no such reference: {key!r}")

    def find_group(self, name: str) -> Header:
        if name not in self.groups:
            raise KeyError(f"no such read group: {name!r}")
        return self.groups[name]

    def text(self) -> str:
        return "".join(f"{h}\n" for h in self.headers)

    def of_type(self, kind: str) -> list[Header]:
        return [h for h in self.headers if h.type == kind]

    def mark_query_grouped(self) -> None:
        """After grouping by name no sort order holds: SO goes, GO is ``query``."""
        for h in self.of_type("HD"):
            h.erase("SO")
            h.set("GO", "query")

    def references_frame(self, spark: SparkSession) -> DataFrame:
        extra = {h.get("SN"): h for h in self.headers if h.type == "SQ"}
        pick = lambda n, tag: extra[n].get(tag, "") or None if n in extra else None
        rows = [(i, n, length, *(pick(n, t) for t in ("SP", "AS", "UR", "M5"))) for i, (n, length) in enumerate(self.references)]
        return spark.createDataFrame(rows, "rindex int, name string, length bigint, species string, assembly string, uri string, checksum string")

    def groups_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, h.get("SM", "") or None, h.get("LB", "") or None, h.get("DS", "") or None, h.get("PU", "") or None, int(h.get("PI", "") or 0) or None) for i, h in self.groups.items()]
        return spark.createDataFrame(rows, "id string, sm string, lb string, ds string, pu string, pi bigint")

    def headers_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, h.type, h.fields, str(h)) for i, h in enumerate(self.headers)]
        return spark.createDataFrame(rows, "line_no int, type string, fields array<struct<tag:string,value:string>>, text string")


def merge_catalogs(*catalogs: HeaderCatalog) -> HeaderCatalog:
    """First @HD; references by name and groups by id in order of appearance; other lines once."""
    lines: list[str] = []
    lengths: dict[str, int] = {}
    seen: set[tuple[str, str]] = set()
    for c in catalogs:
        for h in c.headers:
            key = {"HD": lambda h: "", "SQ": lambda h: h.get("SN"), "RG": lambda h: h.get("ID")}.get(h.type, str)(h)
            if h.type == "SQ":
                length = h.get_int("LN", 0)
                if lengths.setdefault(key, length) != length:
                    raise FormatError(f"reference {key!r} has two lengths")
            if (h.type, key) not in seen:
                seen.add((h.type, key))
                lines.append(str(h))
    lines.sort(key=lambda x: not x.startswith("@HD"))
    return HeaderCatalog(lines)


def parse_header_column(line: Column) -> Column:
    """Header lines as structs of type and fields; malformed lines raise."""
    parts = F.slice(F.split(line, "\t"), 2, 1 << 20)
    fields = F.transform(parts, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.substring(x, F.lit(4), F.length(x)).alias("value")))
    wrong = F.raise_error(F.concat(F.lit("not a header line: "), line)).cast(HEADER_TYPE)
    good = line.rlike("^@[A-Za-z][A-Za-z](\t[A-Za-z][A-Za-z0-9]:[^\t]*)*$")
    return F.when(good, F.struct(F.substring(line, 2, 2).alias("type"), fields.alias("fields"))).otherwise(wrong)


def header_text(header: Column) -> Column:
    return F.concat_ws("\t", F.concat(F.lit("@"), header["type"]), F.transform(header["fields"], lambda x: F.concat(x["tag"], F.lit(":"), x["value"])))


def query_grouped(header: Column) -> Column:
    """As HeaderCatalog.mark_query_grouped(), on a column."""
    grouped = F.struct(F.lit("GO").alias("tag"), F.lit("query").alias("value"))
    kept = F.filter(header["fields"], lambda x: ~x["tag"].isin("SO", "GO"))
    had = F.exists(header["fields"], lambda x: x["tag"] == "GO")
    in_place = F.transform(F.filter(header["fields"], lambda x: x["tag"] != "SO"), lambda x: F.when(x["tag"] == "GO", grouped).otherwise(x))
    fields = F.when(had, in_place).otherwise(F.concat(kept, F.array(grouped)))
    return F.when(header["type"] == "HD", F.struct(header["type"].alias("type"), fields.alias("fields"))).otherwise(header)
