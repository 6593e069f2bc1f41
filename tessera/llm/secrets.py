"""Secret scans over a trigram inverted index, in DataFrame functions only.

On the driver each rule's regex is parsed and turned into a Boolean query over
trigrams that any match must hold (an OR of ANDs). The index lists, for each
block of documents and each trigram that some query names, the documents that
hold it. A rule's candidates are the union over its ANDs of the intersected
postings; only they are verified with the regex. Rules without mandatory
trigrams (plain hex runs) scan every text.

Blocks hold about BLOCK documents, so a common trigram's postings are spread
over as many blocks as there are; the candidates are joined to the texts by
broadcast while few, else by a shuffled join.

Defined results: null text is empty; positions are code points, end exclusive,
of the text as it is; rows that repeat each give a row; null doc_ids stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hinted, stored, table, texts

#: Documents in a block of the index, about.
BLOCK = 4096
#: Strings that a part of a regex may stand for before it counts as anything.
MOST = 64
#: Matches of a text whose spans are appended to one list; such lists are joined at the end.
RUN = 128


@dataclass(frozen=True)
class Rule:
    """A match counts if its group is of at least least characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1

    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The patterns; the first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    # a run of the class is taken whole, so its least length can stand in the pattern and short runs cost nothing
    Rule("access", r"AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", least=15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

Query = frozenset  # of ANDs, each a frozenset of trigrams; an empty AND holds always
TRUE: Query = frozenset({frozenset()})


def simplest(q: Query) -> Query:
    """Without ANDs that another one implies."""
    return frozenset(a for a in q if not any(b < a for b in q))


def both(a: Query, b: Query) -> Query:
    return simplest(frozenset(x | y for x in a for y in b))


def holds(strings: set[str]) -> Query:
    """The query of a text that holds one of strings."""
    return simplest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def characters(items) -> set[str] | None:
    out: set[str] = set()
    for op, v in items:
        if op is K.LITERAL:
            out.add(chr(v).lower())
        elif op is K.RANGE and v[1] - v[0] < MOST:
            out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def analysed(nodes) -> tuple[set[str] | None, Query]:
    """The strings that nodes stand for, if few, and what any match must hold besides."""
    run: set[str] = {""}
    query, exact = TRUE, True
    for op, v in nodes:
        if op is K.LITERAL:
            got, more = {chr(v).lower()}, TRUE
        elif op is K.IN:
            got, more = characters(v), TRUE
        elif op is K.SUBPATTERN:
            got, more = analysed(v[3])
        elif op is K.BRANCH:
            parts = [analysed(x) for x in v[1]]
            if all(s is not None and q == TRUE for s, q in parts):
                got, more = set().union(*(s for s, _ in parts)), TRUE
            else:
                got, more = None, simplest(frozenset().union(*(both(q, holds(s)) if s is not None else q for s, q in parts)))
        elif op is K.MAX_REPEAT and v[1] == 1 and v[0] == 0:
            got, more = analysed(v[2])
            got, more = (got | {""}, TRUE) if got is not None and more == TRUE else (None, TRUE)
        elif op is K.MAX_REPEAT and v[0] >= 1:
            s, q = analysed(v[2])
            got, more = None, both(q, holds(s)) if s is not None else q
        else:
            got, more = None, TRUE
        query = both(query, more)
        if got is not None and len(run) * len(got) <= MOST:
            run = {a + b for a in run for b in got}
            continue
        exact = False
        query = both(query, holds(run))
        run = got if got is not None else {""}
    return (run, query) if exact else (None, both(query, holds(run)))


def trigram_query(rule: Rule) -> Query:
    """Over the lower-cased text; TRUE if the rule has no mandatory trigrams."""
    strings, query = analysed(P.parse(rule.pattern))
    return both(query, holds(strings)) if strings is not None else query


def postings(rows: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """The index: (block, trigram, posting), posting the sorted row keys. rows: (row_key, text)."""
    low = rows.select("row_key", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    pairs = low.select("row_key", F.explode(held).alias("trigram")).where("trigram IS NOT NULL")
    block = F.pmod("row_key", F.lit(blocks)).cast("int").alias("block")
    return pairs.groupBy(block, "trigram").agg(F.array_sort(F.collect_set("row_key")).alias("posting"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(candidate_key, rules): bit r is set where rule r's query holds, by intersecting postings block by block."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "posting"))).alias("lists"))
    ands = [F.struct(F.lit(1 << r).cast("long").alias("bit"), F.array(*map(F.lit, sorted(every))).alias("grams")) for r, q in queries.items() for every in sorted(q, key=sorted)]
    rows = lists.select("lists", F.explode(F.array(*ands)).alias("a"))
    of = lambda t: F.coalesce(F.col("lists")[t], F.array().cast("array<bigint>"))
    hit = F.aggregate(F.col("a.grams"), of(F.col("a.grams")[0]), lambda acc, t: F.array_intersect(acc, of(t)))
    return rows.select(F.col("a.bit").alias("bit"), F.explode(hit).alias("candidate_key")).groupBy("candidate_key").agg(F.bit_or("bit").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches that count, in code points."""
    pattern = F.lit(rule.java())
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.java(), -1)
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), counted.alias("c")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("n"), F.length(m["c"]).alias("c")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(s, x):
        a = s["at"] + x["gap"]
        span = F.array(F.struct(a.alias("start"), (a + x["n"]).alias("end")))
        return F.struct((a + x["n"]).alias("at"), F.when(x["c"] >= rule.least, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def run(held, s, first):
        """RUN matches from the first on: appending copies what was appended before, so runs are kept apart until the end."""
        got = F.aggregate(F.slice(held, first, F.lit(RUN)), F.struct(s["at"].alias("at"), none.alias("out")), step)
        return F.struct(got["at"].alias("at"), F.concat(s["out"], F.array(got["out"])).alias("out"))

    runs = F.sequence(F.lit(1), F.size(whole), F.lit(RUN))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
    # bound by a lambda: as an expression in the loop the text would be searched again for each run
    once = F.transform(F.array(steps), lambda held: F.aggregate(runs, start, lambda s, first: run(held, s, first))["out"])
    return F.when(F.size(whole) > 0, F.flatten(F.get(once, F.lit(0)))).otherwise(none)


def named(spans: Column, number: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_key and found: array<struct<start, rule, end, kind>> by start, then rule."""
    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    queries = {r: trigram_query(rule) for r, rule in enumerate(rules)}
    indexed = {r: q for r, q in queries.items() if frozenset() not in q}
    if indexed:
        blocks = max(1, -(-docs.count() // BLOCK))
        grams = sorted({t for q in indexed.values() for a in q for t in a})
        index = stored(postings(rows, grams, blocks), "trigram-index")
        rows = rows.join(hinted(stored(candidates(index, indexed), "secret-candidates")), F.col("row_key") == F.col("candidate_key"), "left")
    parts = []
    for r, rule in enumerate(rules):
        m = matches(F.col("text"), rule)
        if r in indexed:
            m = F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0, m).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        parts.append(named(m, r, rule.kind))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.array_sort(F.concat(*parts)).alias("found"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined("found").alias("spans"))


