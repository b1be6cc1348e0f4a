"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: the strings with which every match
must contain one (in lower case), each as the AND of its trigrams, joined by OR; of each AND the RAREST trigrams
are asked for (a match holds them all, so fewer lists lose none). One pass over the lower-cased texts gives the trigrams
that some rule asks for, and these become posting lists: for each trigram and shard of documents the
sorted keys of the documents that hold it, stored as a table. A rule's lists are intersected from the shortest on and
united as its query says, shard by shard; what is left are its candidates. Texts of candidates are fetched by
a join on the key and verified with the pattern itself, other texts are not read by that rule. A rule without
mandatory trigrams (hex runs) scans every text.

A key is a hash of id and text; documents whose keys coincide are verified together, which changes no result.

Spans are offsets in code points, end exclusive; matches of a rule are leftmost and do not
overlap. Matches of ``assign`` whose value has under six characters are dropped after matching.

Defined results: a null or empty text has no spans; repeated rows each give a row; an empty table
gives no rows; a text with very many matches takes time in proportion to them, nearly; other columns are not read
(``redact`` keeps them).
"""

from __future__ import annotations

import math
import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, scratch, table_once


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose group of that number is shorter than ``least`` are dropped.
    group: int = 0
    least: int = 0


#: The first three are the base, in the order of its kinds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = 3
MARK = "[secret]"
MOST_STRINGS = 64


def mandatory(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean trigram query of a pattern: a match holds all trigrams of one set at least. None: no mandatory trigrams."""
    best: list[list[str]] = []  # runs of alternatives, one of which every match holds

    def walk(items) -> None:
        runs = [""]

        def stop() -> None:
            nonlocal runs
            best.append(runs)
            runs = [""]

        for op, arg in items:
            some: list[str] | None = None
            if op is sre.LITERAL:
                some = [chr(arg)]
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
                some = [chr(v) for _, v in arg]
            elif op is sre.SUBPATTERN:
                some = exact(arg[3])
            elif op is sre.MAX_REPEAT and arg[1] <= 1:
                inner = exact(arg[2])
                some = inner and ([""] if arg[0] == 0 else []) + inner
            if some is None or len(runs) * len(some) > MOST_STRINGS:
                stop()
            else:
                runs = [a + b for a, b in product(runs, some)]
        stop()

    def exact(items) -> list[str] | None:
        """All strings that a part can match, if they are few."""
        out = [""]
        for op, arg in items:
            if op is sre.LITERAL:
                some = [chr(arg)]
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
                some = [chr(v) for _, v in arg]
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                if any(p is None for p in parts):
                    return None
                some = [s for p in parts for s in p]
            elif op is sre.SUBPATTERN:
                some = exact(arg[3])
            elif op is sre.MAX_REPEAT and arg[1] <= 1 and (inner := exact(arg[2])) is not None:
                some = ([""] if arg[0] == 0 else []) + inner
            else:
                return None
            if some is None or len(out) * len(some) > MOST_STRINGS:
                return None
            out = [a + b for a, b in product(out, some)]
        return out

    walk(parser.parse(pattern))
    usable = [runs for runs in best if all(len(s) >= 3 for s in runs)]
    if not usable:
        return None
    runs = max(usable, key=lambda r: min(map(len, r)))
    clauses = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in runs}
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)  # a clause within another makes that one needless


#: Letters of running text from the commonest to the rarest; other signs are rarer.
COMMON_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
RAREST = 2
SHARD = 1 << 14  # documents


def rarity(gram: str) -> int:
    return sum(COMMON_LETTERS.find(c) if c in COMMON_LETTERS else len(COMMON_LETTERS) for c in gram)


def asked(rule: Rule, rarest: int | None = RAREST) -> list[list[str]] | None:
    """The rule's query with the ``rarest`` trigrams of each AND (None: all)."""
    query = mandatory(rule.pattern)
    return query and [sorted(clause, key=lambda g: (-rarity(g), g))[:rarest] for clause in query]


def trigrams(rules: tuple[Rule, ...] = RULES, rarest: int | None = None) -> list[str]:
    """All trigrams that some rule asks for."""
    return sorted({g for r in rules for clause in asked(r, rarest) or [] for g in clause})


def any_of(grams: list[str]) -> str:
    """A pattern that finds, at every place of a text, the one of ``grams`` that starts there: shared first and second signs are tried once."""
    quote = lambda c: c if c.isalnum() or c == "_" else "\\" + c
    one = lambda some: quote(some[0]) if len(some) == 1 else "[" + "".join(map(quote, sorted(some))) + "]"
    branches = []
    for first in sorted({g[0] for g in grams}):
        thirds: dict[tuple[str, ...], list[str]] = {}
        for second in sorted({g[1] for g in grams if g[0] == first}):
            thirds.setdefault(tuple(sorted(g[2] for g in grams if g[:2] == first + second)), []).append(second)
        branches.append(quote(first) + "(?:" + "|".join(one(seconds) + one(list(third)) for third, seconds in thirds.items()) + ")")
    return "(?=" + one(sorted({g[0] for g in grams})) + ")(?=(" + "|".join(branches) + "))"


def grams(text: Column, rules: tuple[Rule, ...] = RULES, rarest: int | None = None) -> Column:
    """Which of the rules' trigrams a text holds, in one pass."""
    wanted = trigrams(rules, rarest)
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(any_of(wanted)), F.lit(1))) if wanted else F.array().cast("array<string>")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as rows, of all trigrams of the rules: trigram, doc_id."""
    return id_text(docs, id_col, text_col).select(F.explode(grams(F.col("text"), rules)).alias("trigram"), "doc_id")


def posting_lists(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The stored index of ``keyed`` (key, text): shard, trigram, keys (sorted)."""
    shards = max(1, math.ceil(keyed.select("key").count() / SHARD))
    each = keyed.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", F.explode(grams(F.col("text"), rules, RAREST)).alias("trigram"))
    return table_once(each.groupBy("shard", "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys")))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and ranks (of the rules whose query the document's postings meet), from a stored index."""
    none = F.array().cast("array<bigint>")
    held = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))

    def of(rank: int, query: list[list[str]]) -> Column:
        met = none
        for clause in query:
            lists = F.array(*[F.coalesce(F.element_at("lists", F.lit(g)), none) for g in clause])
            lists = F.array_sort(lists, lambda x, y: F.size(x) - F.size(y))
            met = F.array_union(met, F.aggregate(F.slice(lists, 2, len(clause)), F.get(lists, F.lit(0)), lambda a, x: F.array_intersect(a, x)))
        return F.transform(met, lambda k: F.struct(k.alias("key"), F.lit(rank).alias("rank")))

    queries = [(k, q) for k, r in enumerate(rules) if (q := asked(r))]
    if not queries:
        return index.select(F.explode("keys").alias("key"), F.array().cast("array<int>").alias("ranks")).where("false")
    some = held.select(F.explode(F.concat(*[of(k, q) for k, q in queries])).alias("c"))
    return some.groupBy("c.key").agg(F.collect_set("c.rank").alias("ranks"))


def with_candidates(docs: DataFrame, key: str, keyed: DataFrame, rules: tuple[Rule, ...], ranks: str) -> DataFrame:
    """``docs`` with a column ``ranks``: the rules that are to read its text. Spark measures the stored candidates and chooses how to join them."""
    keep: list[DataFrame] = []
    with scratch(keep=keep):
        found = table_once(candidates(posting_lists(keyed, rules), rules))
        keep.append(found)
    own = fresh(docs.columns, "_found_key")
    free = [F.lit(k) for k, r in enumerate(rules) if mandatory(r.pattern) is None]
    always = F.array(*free) if free else F.array().cast("array<int>")
    met = docs.join(found.select(F.col("key").alias(own), F.col("ranks").alias(ranks)), F.col(key) == F.col(own), "left").drop(own)
    return met.withColumn(ranks, F.concat(always, F.coalesce(F.col(ranks), F.array().cast("array<int>"))))


def _long_enough(rule: Rule, match: Column) -> Column:
    return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)


def _running(steps: Column) -> Column:
    """array<struct<at, found>> from array<struct<gap, n, ok>>: pieces of about the root of its length, each with its sum and the spans within it, so that no long array is ever copied for each element."""
    kind = "array<struct<start:int,end:int>>"
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / size).cast("int")), lambda j: F.slice(steps, j * size + 1, size))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["gap"]
        e = s + p["n"]
        own = F.array(F.struct(s.alias("start"), e.alias("end"))).cast(kind)
        return F.struct(e.alias("at"), F.when(p["ok"], F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    return F.transform(cut, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step))


def _placed(pieces: Column, rank: int) -> Column:
    """array<struct<start, rank, end>> of pieces and the sums of those before each."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(pieces, first, lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
    both = F.arrays_zip(pieces.alias("p"), starts.alias("s"))
    return F.flatten(F.transform(both, lambda x: F.transform(x["p"]["found"], lambda f: F.struct((f["start"] + x["s"]).alias("start"), F.lit(rank).alias("rank"), (f["end"] + x["s"]).alias("end")))))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and found, array<struct<start, rank, end>> sorted by start, then the rule's rank."""
    rows = id_text(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    out = with_candidates(rows, "key", rows.select("key", "text"), rules, "ranks")
    ks = range(len(rules))
    # a column that is used twice is a step of its own, so that it is worked out once
    match = [F.when(F.array_contains("ranks", k), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for k, r in enumerate(rules)]
    out = out.select("doc_id", "text", *[c.alias(f"m{k}") for k, c in zip(ks, match)])

    def steps(k: int, r: Rule) -> Column:
        gaps = F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(f"m{k}"))
        return F.when(F.size(f"m{k}") > 0, F.zip_with(gaps, F.col(f"m{k}"), lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), _long_enough(r, m).alias("ok"))))

    out = out.select("doc_id", *[steps(k, r).alias(f"s{k}") for k, r in enumerate(rules)])
    out = out.select("doc_id", *[F.when(F.col(f"s{k}").isNotNull(), _running(F.col(f"s{k}"))).alias(f"p{k}") for k in ks])
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = [F.when(F.col(f"p{k}").isNotNull(), _placed(F.col(f"p{k}"), k)).otherwise(none) for k in ks]
    return out.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def line(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rules[k].kind}") for k in range(BASE)],
        F.sha2(line(F.filter("found", lambda s: s["rank"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


def _without(rule: Rule) -> Callable[[Column], Column]:
    return lambda p: F.concat(p["before"], F.when(p["match"].isNull(), "").when(_long_enough(rule, p["match"]), F.lit(MARK)).otherwise(p["match"]))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by MARK, rule after rule, and its length column kept true; rows and other columns stay."""
    key, ranks = fresh(docs.columns, "_key"), fresh(docs.columns, "_ranks")
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64("doc_id", plain) if "doc_id" in docs.columns and "map<" not in docs.schema["doc_id"].dataType.simpleString() else F.xxhash64(plain)
    out = with_candidates(docs.withColumn(key, hashed), key, docs.select(hashed.alias("key"), plain.alias("text")), rules, ranks)
    for k, rule in enumerate(rules):
        text = F.col(text_col)
        both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"))
        clean = F.when(F.array_contains(ranks, k) & F.rlike(text, F.lit(rule.pattern)), F.array_join(F.transform(both, _without(rule)), "")).otherwise(text)
        out = out.withColumn(text_col, clean)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    kinds = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(f"SELECT r, {k} AS k, '{r.kind}' AS kind, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, {r.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(kinds)}),
e AS (SELECT r, k, kind, i, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n FROM f, unnest(range(1, len(m) + 1)) AS u(i) WHERE length(g[i]) >= least),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans FROM e GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


ORACLE_SQL = _oracle()
