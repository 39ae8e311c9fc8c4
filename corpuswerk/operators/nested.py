"""Deeply nested records as flat node tables linked by interval labels.

A depth-first walk gives every node a pre-order and a post-order number within its record; a
node lies inside another exactly when its pre number is greater and its post number smaller.
One pass over the payloads emits the labelled nodes; the way to the parents is found from the
labels alone, by one window over each record in pre-order. What is a node is told by a tree of
levels; whatever of an object no level reads comes out as path and value in `rest`.

Defined cases: a payload that is null, no JSON or no object gives no node and is listed by
`rejected`; a lone object stands for a list of one; nulls and non-objects in lists are passed
over and don't count; a missing, null or empty part has no nodes; numbers written as text or as
whole floats are read, truth values and numbers beyond 64 bits are none and become null; lone
surrogates become the replacement character; a payload of any depth is read; sentences of a field
are numbered through, its own before those of its paragraphs; a repeated rec_id keeps its records
apart by rec_part, a digest of the payload, exact repetitions of a record give repeated rows and
are told apart within a run by rec_copy, so that no window holds all copies of a record;
extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """Objects under `key` of their parent. attributes: name to (type, path in the object, path in the record where that isn't there).

    Places are counted among the siblings; with counted_in, through all nodes of the level below the nearest such ancestor.
    """

    name: str
    key: str = ""
    attributes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    children: tuple[Level, ...] = ()
    counted_in: str = ""


_CAND = Level("cand", "cand", {"pid": ("string", "pid"), "len": ("bigint", "len"), "resolved": ("boolean", "certain.resolved"), "cap": ("boolean", "certain.cap")})
_TOK = Level(
    "tok", "tok",
    {"word": ("string", "word"), "ix": ("bigint", "ix"), "ixDEP": ("bigint", "ixDEP"), "lemma": ("string", "lemma"), "ner": ("string", "ner"), "iob": ("string", "iob"), "uds": ("string", "tags.uds"), "tt": ("string", "tags.tt"), "ixNP": ("double", "tags.np.ixNP")},
    (_CAND,),
)
_S = Level("s", "s", {"n": ("bigint", "n")}, (_TOK,), "field")
_FIELD = Level("field", "field", {"wert": ("string", "wert"), "id_article": ("bigint", "id_article", "doc.id_article")}, (_S, Level("p", "p", {}, (_S,))))
#: Articles: fields, their paragraphs, sentences in either, tokens, candidates.
ARTICLE = Level("doc", "", {"id": ("string", "doc.id"), "id_article": ("bigint", "doc.id_article"), "docsrc": ("string", "doc.docsrc"), "datum": ("string", "doc.datum"), "autor": ("string", "doc.autor")}, (_FIELD,))
LEVELS = ["doc", "field", "s", "tok", "cand"]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
_SPACE = re.compile(r"[ \t\r\n]*")


def levels_of(root: Level) -> list[Level]:
    """All levels, each name once, parents first."""
    out: dict[str, Level] = {}
    todo = [root]
    while todo:
        level = todo.pop(0)
        out.setdefault(level.name, level)
        todo += level.children
    return list(out.values())


def parse(text: str) -> object:
    """JSON of any depth: as json.loads, with a stack of its own where that runs out of depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    scan, at = json.JSONDecoder(), 0
    holder: list = []
    stack: list[tuple[object, str | None]] = [(holder, None)]  # container and the key its next value goes to
    skip = lambda i: _SPACE.match(text, i).end()

    def put(value: object) -> None:
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key] = value

    def key(i: int) -> int:
        name, i = scan.raw_decode(text, skip(i))
        if not isinstance(name, str) or text[skip(i) : skip(i) + 1] != ":":
            raise ValueError("no key")
        stack[-1] = (stack[-1][0], name)
        return skip(i) + 1

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            box: object = {} if c == "{" else []
            put(box)
            stack.append((box, None))
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                at = key(at) if c == "{" else at
                continue
        else:
            value, at = scan.raw_decode(text, at)
            put(value)
        while len(stack) > 1:  # what follows a value
            at = skip(at)
            box, c = stack[-1][0], text[at : at + 1]
            if c == ",":
                at = key(at + 1) if isinstance(box, dict) else at + 1
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("no end of a list or object")
            stack.pop()
            at += 1
        else:
            if skip(at) != len(text):
                raise ValueError("more than one value")
            return holder[0]


def _objects(x: object) -> list[dict]:
    return [x] if isinstance(x, dict) else [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []


def _plain(text: str) -> str:
    """The text without lone surrogates, which no column can hold."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _read(x: object, kind: str) -> object:
    if x is None or isinstance(x, (dict, list)):
        return None
    if kind == "string":
        return _plain(x) if isinstance(x, str) else json.dumps(x)
    if kind == "boolean":
        return x if isinstance(x, bool) else None
    if isinstance(x, bool):
        return None
    try:
        if kind == "double":
            return float(x)
        if isinstance(x, float):
            exact = int(x)
        else:
            text = str(x).strip()
            exact = int(text) if text.lstrip("+-").isdigit() else int(float(text))
            if exact != float(text) and not text.lstrip("+-").isdigit():
                return None
        return exact if (not isinstance(x, float) or exact == x) and -(2**63) <= exact < 2**63 else None
    except (ValueError, OverflowError, TypeError):
        return None


def _at(node: object, path: tuple[str, ...]) -> object:
    for key in path:
        if not isinstance(node, dict):
            return None
        node = node.get(key)
    return node


def leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
    """(path, text) of every scalar of a value, however deep; nulls are left out, empty lists and objects too."""
    stack = [(path, value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{at}.{k}", v) for k, v in reversed(list(x.items()))]
        elif isinstance(x, list):
            stack += [(f"{at}[{k}]", v) for k, v in reversed(list(enumerate(x)))]
        elif x is not None:
            yield _plain(at), _plain(x) if isinstance(x, str) else json.dumps(x)


class Walker:
    """Labels the nodes of records of one tree of levels."""

    def __init__(self, root: Level, labels_only: bool = False):
        self.root = root
        self.labels_only = labels_only
        self.types = {} if labels_only else {name: spec[0] for level in levels_of(root) for name, spec in level.attributes.items()}
        self.columns = list(self.types)
        self.plans = {id(level): self._plan(level) for level in self._every(root)}

    def _every(self, level: Level) -> Iterator[Level]:
        yield level
        for child in level.children:
            yield from self._every(child)

    def _plan(self, level: Level) -> tuple:
        reads = []
        own: dict = {}  # what is read of an object, as a tree of keys
        for name, (kind, path, *fallback) in () if self.labels_only else level.attributes.items():
            parts = tuple(path.split("."))
            reads.append((self.columns.index(name), kind, parts, tuple(fallback[0].split(".")) if fallback else ()))
            at = own
            for key in parts:
                at = at.setdefault(key, {})
        return reads, own, {c.key for c in level.children}

    def _rest(self, node: dict, known: dict, children: set[str], path: str = "") -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for key, value in node.items():
            if key in known and not known[key] and value.__class__ not in (dict, list):
                continue
            if key not in known:
                if path or key not in children or not isinstance(value, (dict, list)):
                    out += leaves(value, path + key)
                elif isinstance(value, list):
                    for k, x in enumerate(value):
                        if not isinstance(x, dict):
                            out += leaves(x, f"{path}{key}[{k}]")
            elif known[key]:
                out += self._rest(value, known[key], set(), f"{path}{key}.") if isinstance(value, dict) else leaves(value, path + key)
            elif isinstance(value, (dict, list)):
                out += leaves(value, path + key)
        return out

    def walk(self, payload: str) -> list[list]:
        """[level, place, pre, post, values, rest] of every node of one payload, in pre-order."""
        record = parse(payload)
        if not isinstance(record, dict):
            raise ValueError("no object")
        nodes: list[list] = []
        width, left = len(self.columns), 0

        def visit(level: Level, node: dict, place: int, counters: dict[str, dict[str, int]]) -> None:
            nonlocal left
            reads, own, children = self.plans[id(level)]
            values: list = [None] * width
            for at, kind, path, fallback in reads:
                x = _at(node, path)
                if x is None and fallback and path[0] not in node:
                    x = _at(record, fallback)
                values[at] = _read(x, kind)
            rest = None if self.labels_only else self._rest(node, own, children)
            me = [level.name, place, len(nodes), -1, values, rest or None]
            nodes.append(me)
            inner = counters | {level.name: {}}
            for child in level.children:
                through = inner.get(child.counted_in)
                for k, x in enumerate(_objects(node.get(child.key))):
                    if through is not None:
                        k = through[child.name] = through.get(child.name, -1) + 1
                    visit(child, x, k, inner)
            me[3] = left
            left += 1

        visit(self.root, record, -1, {})
        return nodes

    def schema(self) -> str:
        own = [] if self.labels_only else ["rest map<string,string>", *(f"a_{k} {v}" for k, v in self.types.items())]
        return ", ".join(["rec_id bigint, rec_part bigint, rec_copy bigint, level string, place int, pre bigint, post bigint", *own])

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), *(_ARROW[self.types[c]] for c in self.columns)]
        names = ["rec_id", "rec_part", "rec_copy", "level", "place", "pre", "post", "rest", *(f"a_{c}" for c in self.columns)]
        kept = slice(None, 7 if self.labels_only else None)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[kept], kinds[kept])], names[kept])


def _label(root: Level, labels_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(root, labels_only)
        copy = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for rec, part, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    nodes = walker.walk(payload)
                except (ValueError, TypeError):
                    continue
                copy += 1
                rows += [(rec, part, copy, level, place, pre, post, dict(rest) if rest else None, *values) for level, place, pre, post, values, rest in nodes]
                if len(rows) > 20_000:
                    yield walker.batch(rows)
                    rows = []
            if rows:
                yield walker.batch(rows)

    return run


def _own(records: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    return records.select(F.col(id_col).cast("bigint").alias("rec_id"), F.xxhash64(payload_col).alias("rec_part"), F.col(payload_col).alias("payload"))


def labelled_nodes(records: DataFrame, id_col: str = "rec_id", payload_col: str = "payload", root: Level = ARTICLE, labels_only: bool = False) -> DataFrame:
    """Every node of every record with its level, place among siblings, labels and, unless labels_only, attributes (a_*) and what else its object holds (rest)."""
    return _own(records, id_col, payload_col).filter("payload is not null").mapInArrow(_label(root, labels_only), Walker(root, labels_only).schema())


def rejected(records: DataFrame, id_col: str = "rec_id", payload_col: str = "payload") -> DataFrame:
    """(rec_id, rec_part, reason) of the records that give no node: null or json."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = []
            for payload in batch.column(2).to_pylist():
                try:
                    reasons.append("null" if payload is None else None if isinstance(parse(payload), dict) else "json")
                except (ValueError, TypeError):
                    reasons.append("json")
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reasons, pa.string())], ["rec_id", "rec_part", "reason"])
            yield out.filter(pa.array([r is not None for r in reasons], pa.bool_()))

    return _own(records, id_col, payload_col).mapInArrow(judge, "rec_id bigint, rec_part bigint, reason string")


def with_parents(nodes: DataFrame, root: Level = ARTICLE) -> DataFrame:
    """Adds, for each level above a node, the place and pre number of the node that contains it.

    In pre-order the node of a level seen last is the only one that can contain the current node;
    its interval is then checked. Columns: <level>_place, <level>_pre; null where none contains it.
    """
    names = [level.name for level in levels_of(root)[1:]]
    seen = Window.partitionBy("rec_id", "rec_part", "rec_copy").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumns({f"{x}_seen": F.last(F.when(F.col("level") == x, F.struct("pre", "post", "place")), ignorenulls=True).over(seen) for x in names})
    found = {}
    for x in names:
        inside = (F.col(f"{x}_seen.pre") <= F.col("pre")) & (F.col(f"{x}_seen.post") >= F.col("post"))
        found |= {f"{x}_place": F.when(inside, F.col(f"{x}_seen.place")), f"{x}_pre": F.when(inside, F.col(f"{x}_seen.pre"))}
    return out.withColumns(found).drop(*(f"{x}_seen" for x in names))


def places(nodes: DataFrame) -> DataFrame:
    """(rec_id, lvl, field_ix, s_ix, tok_ix, cand_ix) of each node of the five levels of articles, -1 below its level."""
    linked = with_parents(nodes).filter(F.col("level").isin(*LEVELS))
    place = lambda level: F.coalesce(F.col(f"{level}_place"), F.lit(-1)).cast("int").alias(f"{level}_ix")
    return linked.select("rec_id", F.col("level").alias("lvl"), *map(place, LEVELS[1:]))


def node_tables(records: DataFrame, id_col: str = "rec_id", payload_col: str = "payload", root: Level = ARTICLE) -> dict[str, DataFrame]:
    """One flat table per level: keys (rec_id, rec_part, pre, post), places and pre numbers of the levels above, own attributes, rest."""
    linked = with_parents(labelled_nodes(records, id_col, payload_col, root), root)
    levels = levels_of(root)
    above: dict[str, list[str]] = {levels[0].name: []}
    for level in levels:
        for child in level.children:
            for x in [*above[level.name], level.name]:
                above.setdefault(child.name, [])
                if x not in above[child.name] and x != levels[0].name:
                    above[child.name].append(x)
    out = {}
    for level in levels:
        own = [] if level is levels[0] else [level.name]
        keys = [F.col(f"{x}_place").alias(f"{x}_ix") for x in above[level.name] + own] + [F.col(f"{x}_pre") for x in above[level.name]]
        out[level.name] = linked.filter(F.col("level") == level.name).select("rec_id", "rec_part", "pre", "post", *keys, *[F.col(f"a_{k}").alias(k) for k in level.attributes], "rest")
    return out
