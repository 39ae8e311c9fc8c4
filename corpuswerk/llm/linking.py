"""Written names of places and organisations given the gazetteer entry they stand for.

Each distinct spelling is folded (case, umlauts, digits read for letters). A multi-pattern automaton
over the folded canonical names and aliases, as they stand and written together, finds the names
embedded in it; the longest matches that don't overlap win. They decide where they name one entry
and nothing is left over but articles and words of its kind. All other spellings go to token-set
similarity: words of kind are set aside, the other words are compared as a set, whatever their order,
with the candidates found by an index of deletion neighbourhoods, which misses no name within the
allowed edits (0 under 5 letters, 1 under 8, else 2). Among several entries the most similar one,
then the words of kind decide; what has no entry is reported with an empty pid.

Defined cases: as in operators.annotated for tokens and mentions; a spelling that equals a label
or alias is not reported; entries alike in all this leave the mention without an entry, and so do
embedded names of several entries; null labels and aliases count for nothing; an empty gazetteer
leaves every mention without an entry; a very long spelling is scanned whole; repeated entries count
once; other columns are ignored; a gazetteer of more than MAX_ENTRIES names is refused.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswerk.operators.annotated import mentions
from corpuswerk.plans.storage import checked_rows, materialized

#: Entries the gazetteer may have; it is sent to every executor.
MAX_ENTRIES = 100_000
# Words that say what kind of thing is named, each with its short forms.
KINDS = {
    "bank": "bk", "ag": "", "aktiengesellschaft": "", "werke": "", "verkehrsbetriebe": "vb", "verein": "", "verband": "", "partei": "", "gewerkschaft": "", "institut": "", "fur": "", "klimafragen": "",
    "datenschutz": "", "sprachpflege": "", "bodenkunde": "", "bad": "", "sankt": "st", "gross": "gr", "am": "", "an": "", "der": "", "see": "", "hang": "", "die": "", "das": "",
}
ARTICLES = frozenset({"die", "das", "der"})
FOLDS = [("ß", "ss"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("0", "o"), ("1", "l")]


def fold(text: str, plain: bool = False) -> str:
    """Lower case without marks; ae, oe and ue are read for umlauts, unless plain."""
    text = unicodedata.normalize("NFC", text).lower()
    for a, b in FOLDS:
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return text if plain else re.sub(r"(?<=[aou])e", "", text)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps, also of letters that became neighbours by a deletion; more than most comes out as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, c in enumerate(a, 1):
        row, last = [far, i], 0
        for j, d in enumerate(b, 1):
            k = seen.get(d, 0)
            swap = table[k][last] + i - k + j - last - 1
            if c == d:
                row.append(min(table[i][j], swap))
                last = j
            else:
                row.append(min(table[i][j] + 1, row[-1] + 1, table[i][j + 1] + 1, swap))
        table.append(row)
        seen[c] = i
        if min(row) > most and min(table[-2]) > most and min(table[-3]) > most:
            return most + 1
    return min(table[-1][-1], most + 1)


def allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


def deletions(text: str, most: int) -> set[str]:
    out = {text}
    for k in range(1, most + 1):
        out |= {"".join(c for i, c in enumerate(text) if i not in gone) for gone in combinations(range(len(text)), k)}
    return out


def _kinds(word: str) -> list[str]:
    """The words of kind that a folded word, perhaps cut off by a full stop, stands for."""
    bare = word.rstrip(".")
    return [k for k, short in KINDS.items() if bare == k or bare == short or word.endswith(".") and k.startswith(bare)]


def _words(name: str, plain: bool = False) -> list[str]:
    return re.findall(r"[^\W_]+\.?", fold(name, plain))


def _spaced(name: str) -> str:
    """The folded words between blanks."""
    return " ".join(["", *(w.rstrip(".") for w in _words(name)), ""])


def parts(name: str, plain: bool = False) -> tuple[str, frozenset[str]]:
    """The folded name without kind words, written together, and the kind words."""
    kept, kinds = _sorting(name, plain)
    return "".join(kept), kinds


def _sorting(name: str, plain: bool = False) -> tuple[list[str], frozenset[str]]:
    words = _words(name, plain)
    kept, kinds = [], set()
    for w in words:
        full = _kinds(w)
        if full and len(words) > 1:
            kinds |= set(full)
        else:
            kept.append(w.rstrip("."))
    if not kept:
        kept, kinds = [w.rstrip(".") for w in words], set()
    return kept, frozenset(kinds)


def _sorted(name: str, plain: bool = False) -> str:
    return "".join(sorted(_sorting(name, plain)[0]))


def _together(name: str, plain: bool = False) -> str:
    return "".join(re.findall(r"[^\W_]+", fold(name, plain)))


def _readings(text: str) -> set[str]:
    """As it stands, and with r and n read for m."""
    return {text, text.replace("rn", "m")}


def longest_matches(found: list[tuple[int, int, frozenset[str]]]) -> list[tuple[int, int, frozenset[str]]]:
    """Of (start, end, entries) those that win: the longest first, the leftmost at a tie, none overlapping a winner."""
    kept: list[tuple[int, int, frozenset[str]]] = []
    for match in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
        if all(match[1] <= start or end <= match[0] for start, end, _ in kept):
            kept.append(match)
    return kept


class Index:
    """Automaton and deletion neighbourhoods of (pid, name)."""

    def __init__(self, names: list[tuple[str, str]]):
        self.kinds: dict[str, frozenset[str]] = defaultdict(frozenset)
        patterns: dict[str, frozenset[str]] = defaultdict(frozenset)
        for pid, name in names:
            self.kinds[pid] |= parts(name)[1]
            for text in {_spaced(name), f" {_together(name)} "}:
                if text.strip():
                    patterns[text] |= {pid}
        self.automaton = ahocorasick.Automaton()
        for text, pids in patterns.items():
            self.automaton.add_word(text, (len(text), pids))
        self.automaton.make_automaton()
        self.by: dict[str, list[tuple[str, frozenset[str], str]]] = defaultdict(list)
        self.cores = sorted({(parts(name)[0], pid) for pid, name in names})
        written = {(x, self.kinds[pid], pid) for pid, name in names for plain in (False, True) for own in (parts(name, plain)[0], _sorted(name, plain), _together(name, plain)) for x in _readings(own)}
        for name in sorted(written, key=lambda x: (x[0], x[2])):
            for key in deletions(name[0], allowed(len(name[0]))):
                self.by[key].append(name)

    def embedded(self, spelling: str) -> str:
        """The one entry whose names are embedded and leave nothing but articles and words of its kind, or ''."""
        text = _spaced(spelling)
        found = [(end - size + 2, end, pids) for end, (size, pids) in self.automaton.iter(text)] if len(self.automaton) else []
        kept = longest_matches(found)
        entries = frozenset().union(*(pids for _, _, pids in kept))
        if len(entries) != 1:
            return ""
        (pid,) = entries
        rest = list(text)
        for start, end, _ in kept:
            rest[start:end] = " " * (end - start)
        left = {full for w in "".join(rest).split() for full in _kinds(w) or [w]}
        return pid if left <= self.kinds[pid] | ARTICLES else ""

    def _near(self, text: str, kinds: frozenset[str]) -> list[tuple[int, int, str]]:
        found = {name for key in deletions(text, allowed(len(text))) for name in self.by.get(key, ())}
        telling = kinds - ARTICLES
        out = []
        for core, own, pid in found:
            # A name of another kind is rather another name.
            limit = min(allowed(len(core)), 1 if telling and not telling & own else 2)
            d = edits(text, core, limit)
            if d <= limit:
                out.append((d, len(telling - own), pid))
        return out

    def similar(self, spelling: str) -> str:
        """The entry whose set of words is most similar, or ''."""
        core, kinds = parts(spelling)
        found = []
        for plain in (False, True):
            own, whole = {parts(spelling, plain)[0], _sorted(spelling, plain)}, _together(spelling, plain)
            found += [x for each in own for text in _readings(each) for x in self._near(text, kinds)]
            if whole not in own:
                found += [x for text in _readings(whole) for x in self._near(text, frozenset())]
        if not found and core.endswith("s"):
            found = self._near(core[:-1], kinds)
        if not found and len(core) >= 4 and re.search(r"\w{4,}\.", spelling):  # cut off
            found = [(0, 0, pid) for name, pid in self.cores if name.startswith(core)]
        best = {x[2] for x in found if x[:2] == min(found)[:2]}
        return best.pop() if len(best) == 1 else ""

    def find(self, spelling: str) -> str:
        """The pid of the entry meant, or ''."""
        return self.embedded(spelling) or self.similar(spelling)


@cache
def _index(names: tuple[tuple[str, str], ...]) -> Index:
    """One a Python worker."""
    return Index(list(names))


def link(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(sid, ix, pid) of the mentions of places and organisations that equal no name; pid '' where none is meant."""
    spark = rows.sparkSession
    names = gazetteer.select("pid", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).dropna().distinct()
    listed = spark.sparkContext.broadcast(tuple(tuple(r) for r in checked_rows(names.orderBy("pid", "name"), MAX_ENTRIES, "the gazetteer")))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(listed.value)
        for batch in batches:
            pids = pa.array([index.find(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pids], ["spelling", "pid"])

    found = mentions(rows).filter("kind in ('LOC', 'ORG')").join(F.broadcast(names.select(F.col("name").alias("spelling")).distinct()), "spelling", "left_anti")
    found = materialized(found.select("sid", "ix", "spelling"), "spellings")
    # Spellings are short but take long: they are spread over all tasks, however few bytes they are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spellings = found.select("spelling").distinct().repartition(tasks, F.xxhash64("spelling")).mapInArrow(entries, "spelling string, pid string")
    return found.join(spellings, "spelling").select("sid", "ix", "pid")
