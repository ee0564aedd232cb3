"""Secret scan: fixed key patterns, and windows of high Shannon entropy inside candidate strings.

A candidate is a maximal run of one character class. A window slides over it; entering and leaving characters change an
array of counts and a sum of c * log2(c), from which the window's entropy follows. Runs of windows above the class's
threshold become spans unless an allow-list matches. Everything is a built-in expression of one row: no shuffle.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import free_name

# The base kinds in the order in which equal starts are listed, their patterns, and what must be long enough.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_KEY = ASSIGN[: ASSIGN.index("[A-Za-z0-9+/_.=-]+")].removesuffix("(") + "[A-Za-z0-9+/_.=-]"
MIN_ASSIGNED = 6
# A run of the class is taken whole, so a longer-than-minimum run is the same as any run that is then measured.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# log2 sums are kept as integers, so that every engine decides a window alike.
SCALE = 1 << 20


@dataclass(frozen=True)
class EntropyClass:
    """Runs of `alphabet` of at least `window` characters that contain all of `needs`; windows of `min_bits` are hot."""

    kind: str
    alphabet: str
    window: int
    min_bits: float
    needs: tuple[str, ...]

    @property
    def pattern(self) -> str:
        escaped = "".join("\\" + c if c in "-/+" else c for c in self.alphabet)
        return f"[{escaped}]{{{self.window},}}"

    @property
    def terms(self) -> list[int]:
        """c * log2(c) for each count c that a window can hold."""
        return [0] + [round(SCALE * c * math.log2(c)) for c in range(1, self.window + 1)]

    @property
    def limit(self) -> int:
        """A window is hot if its terms sum to no more than this: entropy = log2(window) - sum / window."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.min_bits))


ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", string.digits + "abcdefABCDEF", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    EntropyClass("entropy_upper", string.digits + string.ascii_uppercase, 20, 3.6, ("[0-9]", "[A-Z]")),
    EntropyClass(
        "entropy_base64", string.digits + string.ascii_letters + "+/_-", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]")
    ),
    EntropyClass("entropy_lower", string.digits + string.ascii_lowercase, 20, 3.6, ("[0-9]", "[g-z]")),
    # without separators, so that an allow-list match drops only its own part of a joined run
    EntropyClass("entropy_mixed", string.digits + string.ascii_letters, 20, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
    EntropyClass(
        "entropy_short64", string.digits + string.ascii_letters + "+/_-", 20, 4.0, ("[0-9]", "[a-z]", "[A-Z]")
    ),
)
#: A candidate that one of these matches is no secret: identifiers, placeholders, counting sequences, paths.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|PLACEHOLDER|[Xx]{6,}",
    r"0123456789|9876543210|abcdefgh|ABCDEFGH",
    r"^/?([a-z0-9_-]{1,20}/){2,}[a-z0-9_-]*$",
)
#: A candidate right after one of these is a checksum or an embedded picture.
ALLOWED_BEFORE = r"([Ss][Hh][Aa]-?(1|224|256|384|512)|[Mm][Dd]5|base64,|[Cc]ommit|[Cc]hecksum)[:=\x20-]*[\"']?$"
BEFORE = 24


@dataclass(frozen=True)
class SecretRules:
    classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES
    allowed: tuple[str, ...] = ALLOWED
    allowed_before: str = ALLOWED_BEFORE
    kinds: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "kinds", (*BASE_KINDS, *(c.kind for c in self.classes)))


def find_secrets(docs: DataFrame, text: str = "text", rules: SecretRules | None = None, out: str = "secrets") -> DataFrame:
    """`docs` with a column `out`: spans (start, rank, end, kind) sorted by start and kind, in code points.

    Spans of the base kinds all stay. A span found by entropy is added unless the allow-list or a base span covers it.
    Null and empty texts have no spans. Every input row gives one output row, repeated or not, and keeps its columns;
    only one that is named as `out` is replaced.
    """
    rules = rules or SecretRules()
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def when_seen(pattern: str, spans: Column) -> Column:
        return F.when(body.rlike(pattern), spans).otherwise(none)

    def spans(pattern: str, rank: int, keep=None) -> Column:
        found = _located(body, pattern)
        return _as_spans(F.filter(found, keep) if keep else found, rank, rules.kinds[rank])

    long_enough = lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_ASSIGNED
    base = F.concat(
        when_seen(ASSIGN_KEY, spans(ASSIGN, 0, long_enough)),
        when_seen(ACCESS, spans(ACCESS, 1)),
        when_seen(HEX, spans(HEX, 2)),
    )
    added = [_hot_spans(body, c, len(BASE_KINDS) + i, rules) for i, c in enumerate(rules.classes)]
    shortest = min((c.window for c in rules.classes), default=0)
    any_class = "[A-Za-z0-9+/_-]{%d}" % shortest
    extra = when_seen(any_class, F.concat(*added)) if added else none
    sure, more = free_name(docs, "_base"), free_name(docs, "_extra")
    found = docs.withColumn(sure, base).withColumn(more, extra)
    inside = lambda s: F.exists(sure, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    every = F.concat(sure, F.filter(more, lambda s: ~inside(s)))
    return found.withColumn(out, F.array_sort(every)).drop(sure, more)


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each maximal run of covered characters replaced by `mark`. A null text stays null."""
    body = F.coalesce(F.col(text), F.lit(""))

    def step(a, s):
        gap = F.substring(body, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = s["start"] >= a["at"]
        piece = F.when(fresh, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        # a span that begins where or before the last one ended only extends the mark
        piece = F.when(fresh & (s["start"] == a["at"]) & (a["at"] > 0), F.lit("")).otherwise(piece)
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.char_length(body)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(F.col(secrets), start, step, rest)
    return docs.withColumn(text, F.when(F.size(secrets) > 0, cleaned).otherwise(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _located(body: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value): what stands between matches gives their places."""
    found = F.arrays_zip(
        F.split(body, pattern, -1).alias("gap"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("value")
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a, z):
        start = a["at"] + F.char_length(z["gap"])
        end = start + F.coalesce(F.char_length(z["value"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(z["value"].isNull(), a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    return F.aggregate(found, begin, step, lambda a: a["out"])


def _as_spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
    ))


def _hot_spans(body: Column, c: EntropyClass, rank: int, rules: SecretRules) -> Column:
    """Maximal runs of overlapping hot windows in the candidates of one class."""

    def candidate(m):
        good = F.lit(True)
        for need in c.needs:
            good = good & m["value"].rlike(need)
        for allowed in rules.allowed:
            good = good & ~m["value"].rlike(allowed)
        start = F.greatest(m["start"] - BEFORE, F.lit(0))
        return good & ~F.substring(body, start + 1, m["start"] - start).rlike(rules.allowed_before)

    chosen = F.filter(_located(body, c.pattern), candidate)
    runs = F.transform(chosen, lambda m: F.transform(_hot_runs(m["value"], c), lambda r: F.struct(
        (m["start"] + r["start"]).alias("start"), F.lit(rank).alias("rank"),
        (m["start"] + r["end"]).alias("end"), F.lit(c.kind).alias("kind"),
    )))
    return F.flatten(runs)


def _hot_runs(value: Column, c: EntropyClass) -> Column:
    terms = F.array(*[F.lit(t).cast("long") for t in c.terms])
    codes = F.transform(F.split(value, ""), lambda ch: F.position(ch, F.lit(c.alphabet)))
    entering = F.arrays_zip(
        codes.alias("entering"),
        F.concat(F.array_repeat(F.lit(0), c.window), codes).alias("leaving"),
    )
    runs_type = "array<struct<start:int,end:int>>"
    begin = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("at"), F.array().cast(runs_type).alias("runs"),
    )

    def term(n):
        return F.element_at(terms, n + 1)

    def step(a, z):
        come, go = z["entering"], z["leaving"]
        here = lambda code: F.when(code > 0, F.get(a["counts"], code - 1)).otherwise(F.lit(0))
        # the character that leaves goes first, so that no count exceeds the window
        left = F.when(go > 0, term(here(go) - 1) - term(here(go))).otherwise(F.lit(0).cast("long"))
        n = here(come) - F.when(come == go, F.lit(1)).otherwise(F.lit(0))
        total = a["sum"] + left + term(n + 1) - term(n)
        counts = F.transform(a["counts"], lambda v, i: v + F.when(i == come - 1, 1).otherwise(0) - F.when(i == go - 1, 1).otherwise(0))
        end = a["at"] + 1
        start = end - c.window
        hot = (start >= 0) & (total <= c.limit)
        last = F.try_element_at(a["runs"], F.lit(-1))
        grown = F.concat(
            F.slice(a["runs"], 1, F.greatest(F.size(a["runs"]) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), end.alias("end"))),
        )
        fresh = F.concat(a["runs"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        joins = (F.size(a["runs"]) > 0) & (last["end"] >= start)
        runs = F.when(~hot, a["runs"]).when(joins, grown).otherwise(fresh)
        moved = F.struct(counts.alias("counts"), total.alias("sum"), end.alias("at"), runs.alias("runs"))
        # the zip is a window longer than the string: nothing enters there
        return F.when(come.isNull(), a).otherwise(moved)

    return F.aggregate(entering, begin, step, lambda a: a["runs"])
