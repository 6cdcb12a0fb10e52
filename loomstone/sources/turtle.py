"""Turtle as triples with typed literals, read in bounded memory.

``statements`` reads a document in chunks of text: it cuts tokens, gathers those
of one statement, and gives its triples; only prefixes, the base and a counter of
blank nodes stay. Two scans use it. ``turtle`` gets the lines of all files from
Spark's own text reader, so it reads whatever store Spark reads; a file's lines
meet in one task, in order, as prefixes hold for what follows them.
``TurtleSource`` is a Spark data source (``spark.read.format("turtle")``) with a
partition for each file, which streams files itself and takes filters on
predicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import batched
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

CHUNK_CHARS = 1 << 20  # read at once from a file
TOKEN_CHARS = 16 << 20  # most of one literal, IRI or comment
_GUARD = 64  # a token this near to the end of a chunk may go on in the next one
_ROWS = 4096  # of an Arrow batch

SCHEMA = "graph_id string, s string, p string, o string, o_kind string, datatype string, lang string"
_ARROW = pa.schema([(name.split()[0], pa.string()) for name in SCHEMA.split(", ")])

Triple = tuple[str, str, str, str, str | None, str | None]  # s, p, o, kind, datatype, language

_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)
    |(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\'|"(?!"")(?:[^"\\\n]|\\.)*"|'(?!\'\')(?:[^'\\\n]|\\.)*')
    |<(?P<iri>[^<>"{}|^`\s]*)>
    |(?P<dir>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[^:\s]*:?\s*<))
    |@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[\w](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[;,.\[\]()])''',
    re.S | re.X,
)
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)
_CONTROLS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
_FRESH = "_:new"  # nodes without a name get numbers after it; written names that begin so get "_" after it

Token = tuple[str, str]


def _unescaped(said: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROLS.get(m[3], m[3]), said)


def _tokens(chunks: Iterable[str]) -> Iterator[Token]:
    """The tokens of a text that comes in chunks; a token may lie over several."""
    held, rest = "", iter(chunks)
    more = True
    while more:
        chunk = next(rest, None)
        more = chunk is not None
        held, at = held + (chunk or ""), 0
        while at < len(held):
            m = _TOKEN.match(held, at)
            if more and (m is None or m.end() > len(held) - _GUARD):
                if len(held) - at > TOKEN_CHARS:
                    raise ValueError(f"not Turtle: no token at {held[at : at + 30]!r}")
                break
            if m is None:
                raise ValueError(f"not Turtle at {held[at : at + 30]!r}")
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group(m.lastgroup)
            at = m.end()
        held = held[at:]


def _cut(tokens: Iterator[Token]) -> Iterator[list[Token]]:
    """The tokens of each statement."""
    now: list[Token] = []
    for kind, said in tokens:
        now.append((kind, said))
        if now[0][0] == "dir" and now[0][1][0] != "@":  # such directives end without a point
            done = len(now) == (3 if now[0][1].lower() == "prefix" else 2)
        else:
            done = kind == "mark" and said == "."
        if done:
            yield now
            now = []
    if now:
        raise ValueError(f"not Turtle: {now[-1][1]!r} at the end, where '.' was due")


class _Reader:
    """Prefixes, the base and a counter; ``read`` gives the triples of one statement."""

    def __init__(self) -> None:
        self.base, self.prefixes, self.blanks = "", {}, 0

    def read(self, tokens: list[Token]) -> list[Triple]:
        self.tokens, self.at, self.triples = tokens, 0, []
        self.statement()
        return self.triples

    def next(self, wanted: str | None = None) -> Token:
        kind, said = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if wanted is not None and said != wanted:
            raise ValueError(f"not Turtle: {said!r} where {wanted!r} was due")
        self.at += 1
        return kind, said

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else ""

    def fresh(self) -> str:
        self.blanks += 1
        return f"{_FRESH}{self.blanks}"

    def iri(self, said: str) -> str:
        said = _unescaped(said)
        return said if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", said) else urljoin(self.base, said)

    def statement(self) -> None:
        if self.tokens[0][0] == "dir":
            kind = self.next()[1].lower()
            if kind.endswith("prefix"):
                name = self.next()[1]
                self.prefixes[name.partition(":")[0]] = self.iri(self.next()[1])
            else:
                self.base = self.iri(self.next()[1])
            if kind[0] == "@":
                self.next(".")
            return
        opened = self.peek() == "["
        subject = self.term()[0]
        if not (opened and self.peek() == "."):
            self.properties(subject)
        self.next(".")

    def properties(self, subject: str) -> None:
        while True:
            predicate, kind, *_ = self.term()
            if kind != "iri":
                raise ValueError(f"not Turtle: {predicate!r} as a predicate")
            while True:
                self.triples.append((subject, predicate, *self.term()))
                if self.peek() != ",":
                    break
                self.next()
            while self.peek() == ";":
                self.next()
            if self.peek() in (".", "]") or self.tokens[self.at - 1][1] != ";":
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, said = self.next()
        if kind == "text":
            size = 3 if said[:3] in ('"""', "'''") else 1
            datatype, lang = XSD + "string", None
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                datatype, lang = RDF + "langString", self.next()[1].lower()
            elif self.peek() == "^^":
                self.next()
                datatype = self.term()[0]
            return _unescaped(said[size:-size]), "literal", datatype, lang
        if kind == "iri":
            return self.iri(said), "iri", None, None
        if kind == "blank":
            return (f"{_FRESH}_{said[len(_FRESH) :]}" if said.startswith(_FRESH) else said), "blank", None, None
        if kind == "number":
            return said, "literal", XSD + ("double" if "e" in said.lower() else "decimal" if "." in said else "integer"), None
        if kind == "word":
            return (RDF + "type", "iri", None, None) if said == "a" else (said, "literal", XSD + "boolean", None)
        if kind == "name":
            prefix, _, local = said.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"not Turtle: no prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if said == "[":
            node = self.fresh()
            if self.peek() != "]":
                self.properties(node)
            self.next("]")
            return node, "blank", None, None
        if said == "(":
            items = []
            while self.peek() != ")":
                items.append(self.term())
            self.next(")")
            nodes = [self.fresh() for _ in items]
            nil = (RDF + "nil", "iri", None, None)
            for i, (node, item) in enumerate(zip(nodes, items, strict=True)):
                rest = (nodes[i + 1], "blank", None, None) if i + 1 < len(nodes) else nil
                self.triples += [(node, RDF + "first", *item), (node, RDF + "rest", *rest)]
            return (nodes[0], "blank", None, None) if nodes else nil
        raise ValueError(f"not Turtle: {said!r}")


def statements(chunks: Iterable[str]) -> Iterator[Triple]:
    """(s, p, o, kind, datatype, language) of a Turtle document that comes in chunks of text.

    Kind is iri, blank or literal. Literals have a datatype (plain ones
    xsd:string, numbers and truth values their own, those with a language
    rdf:langString); IRIs and blank nodes have none. Prefixes, bases, lists,
    collections, blank nodes, both kinds of quotes and escapes are read. What is
    held is a chunk, a statement and the prefixes. Empty documents have no
    triples; anything that is not Turtle raises ``ValueError``.
    """
    reader = _Reader()
    for tokens in _cut(_tokens(chunks)):
        yield from reader.read(tokens)


def turtle_triples(text: str | None) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind) of a whole document; null and empty ones have none."""
    return [t[:4] for t in statements([text or ""])]


def turtle_frame(spark: SparkSession, text: str, graph_id: str | None = None) -> DataFrame:
    """The triples of a small document held as a string, such as shapes."""
    return spark.createDataFrame([(graph_id, *t) for t in statements([text])], SCHEMA)


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], schema=_ARROW)


def _of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files, a file's in order -> triples."""

    def lines() -> Iterator[tuple[str, str]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    rest = lines()
    ahead = next(rest, None)

    def chunks_of(name: str) -> Iterator[str]:
        nonlocal ahead
        held, size = [], 0
        while ahead is not None and ahead[0] == name:
            held.append(ahead[1])
            size += len(ahead[1])
            ahead = next(rest, None)
            if size > CHUNK_CHARS:
                yield "\n".join(held) + "\n"
                held, size = [], 0
        yield "\n".join(held) + "\n"

    def rows() -> Iterator[tuple]:
        while ahead is not None:
            name = ahead[0]
            yield from ((name.rpartition("/")[2], *t) for t in statements(chunks_of(name)))

    yield from _batches(rows())


def turtle(spark: SparkSession, path: str, pattern: str = "*.ttl") -> DataFrame:
    """(graph_id, s, p, o, o_kind, datatype, lang) of all Turtle files below a folder; a graph is a file's name.

    Files of other names, such as lines of N-Triples that Spark wrote, are read with another ``pattern``.

    Files come as lines from Spark's text reader, from any store it reads; the
    lines of a file are put in order and streamed through one task; a line break
    in a literal is read as ``\\n``. A folder without such files gives none; a file
    that is not Turtle fails the query.
    """
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    lines = read.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    dealt = lines.repartition("path").sortWithinPartitions("path", "block", "at")
    return dealt.select("path", "value").mapInArrow(_of_lines, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.predicates = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality of and membership in predicates are tested before a row is made."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("p",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.predicates = wanted if self.predicates is None else self.predicates & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        here = store.get_file_info(root)
        found = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(".ttl")] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import codecs

        from pyarrow import fs

        def chunks() -> Iterator[str]:
            store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
            decoder = codecs.getincrementaldecoder("utf-8")()
            with store.open_input_stream(partition.path) as f:
                while data := f.read(CHUNK_CHARS):
                    yield decoder.decode(data)
                yield decoder.decode(b"", final=True)

        name = partition.path.rpartition("/")[2]
        if partition.path:
            yield from _batches((name, *t) for t in statements(chunks()) if self.predicates is None or t[1] in self.predicates)


class TurtleSource(DataSource):
    """``spark.read.format("turtle").load(path)``: all ``.ttl`` files below a path that pyarrow's file systems read.

    Rows are those of ``turtle``; register it with ``register``. With
    ``spark.sql.python.filterPushdown.enabled`` filters on ``p`` reach the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format ``turtle`` known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TurtleSource)
