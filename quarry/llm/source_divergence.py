"""Source divergence audit: how far the sources of a language differ in their words, by a sort-based scan.

1. Every task counts the terms of its documents and sends one row for each (lang, term, source) of some
   thousand documents: the least document of these, in how many of them the term stands, and how often.
2. These rows are repartitioned by (lang, term) and sorted by (lang, term, source, document).  A scan by run
   lengths, in constant memory but for the sources of one term, adds up document frequency and counts.  A run
   whose term stands in at least `min_docs` documents of the language becomes one row.
3. Totals of groups and languages follow from the runs.  The runs of a language are dealt to slices of some
   2^17 entries; a slice meets the totals of its groups and emits partial sums for each pair of sources, and
   its own best terms of each source.  A language of very many sources is cut into blocks of about BLOCK
   sources, and a slice then works on two blocks.
4. The partial sums of a pair are added; terms that no source of the two blocks has enter by one product.

With count occurrences of a term in a group and N of all V kept terms, p = 1 + floor(10^9 (count + 2) / (N + 2V)).
Divergence of p and q is floor((p - q)^2 / (p + q)).  All arithmetic is on integers; N may reach 9 * 10^15.

Defined results: null text, lang and source are ''.  Each row is a document, rows that repeat or share an id too.
A group whose documents have no term is compared all the same.  A language without kept terms gives pairs of
value 0; one with a single source gives no pairs.  Equal values rank in UTF-8 order of the item.  A very long
text is counted whole in its task, in time linear in its length.  An empty table gives an empty result.  Only
doc_id, text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import discard, read, spool

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # bytes of letters and of everything beyond ASCII
HELD = 1 << 18  # terms that a task holds before it sends them
SLICE = 1 << 17  # entries of a slice
BLOCK = 256  # sources of a block
CELLS = 1 << 20  # cells of a table of terms by sources that is held at once
_PART = "lang string, term string, source string, document long, docs long, n long"
_SCAN = "lang string, part string, source string, item string, value long, terms long, rest long, v long"


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, doc_id, text): partial rows, and a row with null term for each group."""
    held: dict[tuple[str, str], list] = {}

    def rows() -> pa.RecordBatch:
        lang, term, source, document, docs, n = [], [], [], [], [], []
        for (a, b), (first, count, seen) in held.items():
            size = len(count) + 1
            lang += [a] * size
            source += [b] * size
            document += [first] * size
            term += [None, *count]
            n += [0, *count.values()]
            docs += [0, *(seen[t] for t in count)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), _text(term), pa.array(source, pa.string()), *(pa.array(x, pa.int64()) for x in (document, docs, n))], ["lang", "term", "source", "document", "docs", "n"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for lang, source, doc_id, text in zip(*columns, batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
            group = held.setdefault((lang, source), [doc_id, Counter(), Counter()])
            if doc_id is not None and (group[0] is None or doc_id < group[0]):
                group[0] = doc_id
            if text:
                terms = TERM.findall(text.lower())  # of bytes: A-Z only
                group[1].update(terms)
                group[2].update(set(terms))
        if sum(len(g[1]) for g in held.values()) >= HELD:
            yield rows()
            held = {}
    if held:
        yield rows()


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    out = np.ones(len(columns[0]), bool)
    for c in columns if len(out) > 1 else ():
        changed = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        out[1:] = changed if c is columns[0] else out[1:] | changed
    return out


def _runs(min_docs: int):
    """From sorted (lang, term, source, docs, n): (lang, term, total, sources, counts) of each kept term."""

    def shrink(t: pa.Table) -> pa.Table:
        """One row for each (lang, term, source)."""
        lang, term, source = (t.column(k).combine_chunks() for k in range(3))
        at = np.flatnonzero(_changes(lang, term, source))
        return pa.table([c.take(pa.array(at)) for c in (lang, term, source)] + [pa.array(np.add.reduceat(t.column(k).to_numpy(), at)) for k in (3, 4)], names=t.column_names)

    def closed(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The kept runs of whole terms."""
        docs, n = (np.add.reduceat(t.column(k).to_numpy(), starts) for k in (3, 4))
        ends = np.append(starts[1:], t.num_rows)
        keep = docs >= min_docs
        inside = pa.array(np.repeat(keep, ends - starts))
        offsets = pa.array(np.concatenate([[0], np.cumsum((ends - starts)[keep])]).astype(np.int32))
        first = pa.array(starts[keep])
        lists = [pa.ListArray.from_arrays(offsets, t.column(k).combine_chunks().filter(inside)) for k in (2, 4)]
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(first), t.column(1).combine_chunks().take(first), pa.array(n[keep]), *lists], ["lang", "term", "total", "sources", "counts"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = shrink(pa.concat_tables([open_run, t]) if open_run is not None else t)
            starts = np.flatnonzero(_changes(t.column(0).combine_chunks(), t.column(1).combine_chunks()))
            last, open_run = int(starts[-1]), t.slice(starts[-1])
            if last:
                yield closed(t.slice(0, last), starts[:-1])
        if open_run is not None:
            yield closed(open_run, np.zeros(1, np.int64))

    return emit


def share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (n + 2v)) by long division in digits of a thousand."""
    rest, of = np.broadcast_arrays(count + 2, n + 2 * v)
    q = rest // of
    for _ in range(3):
        rest = rest % of * 1000
        q = q * 1000 + rest // of
    return q + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _best(value: np.ndarray, at: np.ndarray, terms: list[bytes], top: int) -> list[tuple[int, bytes]]:
    """The top values at these places, ties by term."""
    if len(at) > top:
        least = np.partition(value[at], len(at) - top)[len(at) - top]
        at = at[value[at] >= least]
    return sorted(((-int(value[i]), terms[i]) for i in at.tolist()))[:top]


def _scan(top: int):
    """Partial sums of pairs and best terms of a slice; runs (term, total, sources, counts) meet groups (source, n, v, n_lang, block)."""

    def emit(key: tuple, runs: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        names = groups.column("source").to_pylist()
        n, block = groups.column("n").to_numpy(), groups.column("block").to_numpy()
        v, n_lang = groups.column("v")[0].as_py(), groups.column("n_lang").to_numpy()[:1]
        ones, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
        sums = np.zeros((len(names), len(names)), np.int64)
        best: list[list] = [[] for _ in names]
        place = {s: i for i, s in enumerate(names)}
        step = max(1, CELLS // max(1, len(names)))
        for a in range(0, runs.num_rows, step):
            part = runs.slice(a, step)
            lists = part.column("sources").combine_chunks()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            count = np.zeros((part.num_rows, len(names)), np.int64)
            count[row, np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)] = part.column("counts").combine_chunks().flatten().to_numpy()
            p = share(count, n[None, :], v)
            for i in ones.tolist():
                with_ = others[others > i] if low == high else others
                sums[i, with_] += divergence(p[:, i : i + 1], p[:, with_]).sum(axis=0)
            if low == high:
                terms = part.column("term").cast(pa.binary()).to_pylist()
                q = share(part.column("total").to_numpy(), n_lang, v)
                for i in ones.tolist():
                    value = divergence(p[:, i], q)
                    found = _best(value, np.flatnonzero((count[:, i] > 0) & (p[:, i] > q)), terms, top)
                    best[i] = sorted(best[i] + found)[:top]
        none = share(np.zeros(len(names), np.int64), n, v) if v else np.ones(len(names), np.int64)
        x, y = np.repeat(ones, len(others)), np.tile(others, len(ones))
        if low == high:
            x, y = x[x < y], y[x < y]
        own = [(i, term, -value) for i, found in enumerate(best) for value, term in found]
        columns = {
            "part": ["pair"] * len(x) + ["term"] * len(own),
            "source": [names[i] for i in x.tolist()] + [names[i] for i, _, _ in own],
            "item": [names[i] for i in y.tolist()] + [t.decode("utf-8", "replace") for _, t, _ in own],
            "value": sums[x, y].tolist() + [w for _, _, w in own],
            "terms": [runs.num_rows] * (len(x) + len(own)),
            "rest": divergence(none[x], none[y]).tolist() + [0] * len(own),
        }
        size = len(columns["part"])
        kinds = [pa.string()] * 3 + [pa.int64()] * 3
        return pa.table([pa.array([lang] * size, pa.string()), *(pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)), pa.array([v] * size, pa.int64())], names=["lang", *columns, "v"])

    return emit


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source of a source's language, and its most telling terms."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = spool(texts.mapInArrow(_counted, _PART), "parts")
    dealt = parts.filter("term is not null").repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    runs = spool(dealt.drop("document").mapInArrow(_runs(min_docs), "lang string, term string, total long, sources array<string>, counts array<long>"), "runs")

    groups = parts.filter("term is null").select("lang", "source").distinct()
    entries = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = runs.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"), F.ceil(F.sum(F.size("sources")) / SLICE).alias("slices"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(of_lang, "lang", "left").fillna({"v": 0, "n_lang": 0, "slices": 1})
    langs = spool(langs.selectExpr("lang", "v", "n_lang", "slices", "blocks"), "langs")
    stats = groups.join(totals, ["lang", "source"], "left").fillna({"n": 0}).join(langs, "lang").selectExpr("lang", "source", "n", "v", "n_lang", "slices", "blocks", "pmod(xxhash64(source), blocks) AS block")
    stats = spool(stats, "stats")
    discard(parts)

    pairs = "explode(flatten(transform(sequence(0L, blocks - 1), a -> transform(sequence(a, blocks - 1), b -> struct(a AS low, b AS high))))) AS at"
    here = runs.join(langs, "lang").selectExpr("*", pairs).selectExpr(
        "lang", "pmod(xxhash64(term), slices) AS slice", "at.low", "at.high", "term", "total",
        "filter(arrays_zip(sources, counts), x -> pmod(xxhash64(x.sources), blocks) IN (at.low, at.high)) AS x",
    ).filter("size(x) > 0").selectExpr("lang", "slice", "low", "high", "term", "total", "x.sources AS sources", "x.counts AS counts")
    theirs = stats.selectExpr("*", pairs).filter("block IN (at.low, at.high)").selectExpr("*", "explode(sequence(0L, slices - 1)) AS slice").selectExpr("lang", "slice", "at.low", "at.high", "source", "n", "v", "n_lang", "block")
    key = ["lang", "slice", "low", "high"]
    found = here.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(_scan(top), _SCAN)
    found = spool(found, "partial")
    discard(runs, stats, langs)

    whole = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.expr("sum(value) + (max(v) - sum(terms)) * max(rest)").alias("value"))
    both = whole.unionByName(whole.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    every = both.unionByName(found.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return every.withColumn("rank", F.row_number().over(order)).filter(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS c FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(c)::HUGEINT AS n, count(*) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
p AS (
  SELECT x.lang, x.source, x.term, x.n, 1 + 1000000000::HUGEINT * (x.n + 2) // (s.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (x.total + 2) // (v.n + 2 * v.v) AS q
  FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
