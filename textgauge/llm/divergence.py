"""Source divergence audit: how far the sources of a language differ in their terms.

1. Each input partition counts its terms by vectorised SQL (DuckDB, in memory) and sends
   one row for each language, source and term.
2. Shards by hash of language and term add these up, keep the terms that enough documents
   hold, and write the kept counts as one compressed block.
3. From the shards' blocks SQL again makes partial sums over the terms that two sources
   both hold, and a shard's best terms of each group.  Spark adds sums up and ranks.

Pairs of sources are summed over all kept terms, but most terms occur in few
sources.  With f(a, b) a term's value and 0 for a count of none,

    sum f(a, b) = V f(0, 0) + sum over a's terms [f(a, 0) - f(0, 0)] + sum over b's terms
    [f(0, b) - f(0, 0)] + sum over common terms [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)],

where the middle sums depend on counts alone, so they come from a table of how many
terms have a count.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import OWNER_BYTES, byte_set, keyed, materialize, partitions, pieces, texts, word_runs

#: Documents of its language that hold a kept term, and ranks given of terms.
LEAST_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Bytes of text cut into terms at once, and rows of counts beyond which these are added up.
_PIECE, _ROWS = 8 << 20, 1 << 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = byte_set(low=(97, 122), beyond=(128, 255))


def _engine() -> duckdb.DuckDBPyConnection:
    """A database in memory, of one thread, that writes nothing anywhere."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "2GB", "temp_directory": "", "autoinstall_known_extensions": False})
    con.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q").fetchall()
    return con


def _run(con: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    """Run a statement to its end; the few rows that it has."""
    return con.execute(sql).fetchall()


def _batches(con: duckdb.DuckDBPyConnection, sql: str):
    yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=1 << 16)


_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_ADDED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Terms of texts, and the text that each is from."""
    low = _FOLD[data]
    start, end, first = word_runs(low, offsets, _LETTER)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[_LETTER[low]])))
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), words


def _add_up(con: duckdb.DuckDBPyConnection) -> int:
    _run(con, f"CREATE TABLE added AS {_ADDED}")
    _run(con, "DROP TABLE counts")
    _run(con, "ALTER TABLE added RENAME TO counts")
    return _run(con, "SELECT count(*) FROM counts")[0][0]


def _count(batches):
    """Counts by language, source and term of one input partition."""
    con = _engine()
    _run(con, "CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    for b in batches:
        data, offsets = texts(b.column(0))
        groups = {}
        code = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], np.int32)
        con.register("names", pa.table({"g": pa.array(range(len(groups)), pa.int32()), "lang": pa.array([g[0] for g in groups], pa.string()), "source": pa.array([g[1] for g in groups], pa.string())}))
        for i, j in pieces(offsets, _PIECE):
            row, words = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            con.register("words", pa.table({"r": pa.array(row), "g": pa.array(code[i:j][row]), "term": words}))
            _run(con, """
                INSERT INTO counts SELECT lang, source, term, n, docs FROM names JOIN (
                    SELECT g, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
                    FROM (SELECT r, g, term, count(*) AS n FROM words GROUP BY ALL) GROUP BY ALL) USING (g)""")
            con.unregister("words")
            if _run(con, "SELECT count(*) FROM counts")[0][0] > _ROWS:
                yield from _batches(con, _ADDED)
                _run(con, "DELETE FROM counts")
        con.unregister("names")
    yield from _batches(con, _ADDED)
    con.close()


def _keep(least: int):
    """Kept counts of one shard as a block, and what all shards have to know of them."""

    def run(batches):
        con, limit = _engine(), _ROWS
        _run(con, "CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for b in batches:
            con.register("more", pa.table(b.columns, names=["lang", "source", "term", "n", "docs"]))
            _run(con, "INSERT INTO counts SELECT * FROM more")
            con.unregister("more")
            if _run(con, "SELECT count(*) FROM counts")[0][0] > limit:
                limit = max(_ROWS, 2 * _add_up(con))
        _run(con, f"""
            CREATE TABLE kept AS SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM counts
            JOIN (SELECT lang, term FROM counts GROUP BY ALL HAVING sum(docs) >= {least}) USING (lang, term) GROUP BY ALL""")
        block = con.sql("SELECT * FROM kept ORDER BY lang, term, source").to_arrow_table()
        if block.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(block)
            yield pa.RecordBatch.from_pydict({"part": ["block"], "lang": pa.array([None], pa.string()), "source": pa.array([None], pa.string()), "n": pa.array([None], pa.int64()), "terms": pa.array([None], pa.int64()), "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            yield from _batches(con, "SELECT 'lang' AS part, lang, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS n, count(DISTINCT term) AS terms, CAST(NULL AS BLOB) AS block FROM kept GROUP BY lang")
            yield from _batches(con, "SELECT 'counts' AS part, lang, source, n, count(*) AS terms, CAST(NULL AS BLOB) AS block FROM kept GROUP BY lang, source, n")
        con.close()

    return run


def _audit(groups: pa.Table, langs: pa.Table, top: int):
    """Partial sums of pairs and best terms, from a shard's block."""

    def run(batches):
        for b in batches:
            for block in b.column(0):
                con = _engine()
                con.register("kept", pa.ipc.open_stream(pa.py_buffer(block.as_buffer())).read_all())
                con.register("groups", groups)
                con.register("langs", langs)
                _run(con, f"""
                    CREATE TABLE k AS SELECT g, dense_rank() OVER (ORDER BY lang, term) AS t, lang, source, term, n,
                           CAST(1 + ({SCALE}::HUGEINT * (n + 1)) // base AS BIGINT) AS p, CAST(1 + {SCALE} // base AS BIGINT) AS p0
                    FROM kept JOIN groups USING (lang, source)""")
                yield from _batches(con, """
                    SELECT 'pair' AS part, x.lang, x.source, y.source AS item, CAST(v AS BIGINT) AS value FROM (
                        SELECT x.g AS a, y.g AS b, sum(f(x.p, y.p) - f(x.p, y.p0) - f(x.p0, y.p) + f(x.p0, y.p0)) AS v
                        FROM k x JOIN k y ON x.t = y.t AND x.g <> y.g GROUP BY ALL) s
                    JOIN groups x ON x.g = s.a JOIN groups y ON y.g = s.b""")
                yield from _batches(con, f"""
                    SELECT 'term' AS part, lang, source, term AS item, f(p, q) AS value FROM (
                        SELECT k.*, CAST(1 + ({SCALE}::HUGEINT * (whole + 1)) // l.base AS BIGINT) AS q
                        FROM k JOIN (SELECT t, CAST(sum(n) AS BIGINT) AS whole FROM k GROUP BY t) USING (t) JOIN langs l USING (lang))
                    WHERE p > q QUALIFY row_number() OVER (PARTITION BY g ORDER BY f(p, q) DESC, term) <= {top}""")
                con.close()

    return run


def _share(n: Column, base: Column) -> Column:
    """1 + floor(SCALE (n + 1) / base), exact."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * (n + 1).cast("decimal(20,0)"), base.cast("decimal(20,0)"))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Pairs of sources by how far their term shares are apart, and each source's most
    typical terms: lang, source, part, item, value, rank.

    Takes ``text``, ``lang`` and ``source``; other columns are ignored, and null counts
    as empty in all three, so '' is a language and a source like others.  A term is a run
    of ASCII letters (lower-cased) and characters beyond ASCII.  A language keeps the terms
    that at least ``least_docs`` of its rows hold; repeated rows are rows of their own.
    Ties of ``value`` go by the item's UTF-8 bytes.  A group without terms, and one
    whose language keeps none, has its pairs all the same; a language of one source has
    none.  An empty table gives no rows.

    The table of groups goes to all tasks: every two groups of a language are a row of the
    result, so it is no larger than the result's root for each language.
    """
    spark = docs.sparkSession
    kinds = ["text", "lang", "source"]
    docs = spread_rows(keyed(docs, *kinds).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kinds]))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // OWNER_BYTES))
    counts = docs.mapInArrow(_count, _COUNTS).repartition(shards, "lang", "term")
    kept = materialize(counts.mapInArrow(_keep(least_docs), "part string, lang string, source string, n bigint, terms bigint, block binary"))
    # how many kept terms have which count, and what follows: sums by group and by language
    hold = materialize(kept.where("part = 'counts'").groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms")))
    sums = hold.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n"))
    terms = kept.where("part = 'lang'").groupBy("lang").agg(F.sum("terms").alias("v"))
    own = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = materialize(own.select("lang", "source", F.coalesce("v", F.lit(0)).cast("bigint").alias("v"), (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("bigint").alias("base")))
    known = groups.where("base > 0").orderBy("lang", "source").collect()
    by_lang: dict[str, int] = {}
    for r in known:
        by_lang[r.lang] = by_lang.get(r.lang, r.v) + r.base - r.v
    group_table = pa.table({"g": pa.array(range(len(known)), pa.int32()), "lang": pa.array([r.lang for r in known], pa.string()), "source": pa.array([r.source for r in known], pa.string()), "base": pa.array([r.base for r in known], pa.int64())})
    lang_table = pa.table({"lang": pa.array(list(by_lang), pa.string()), "base": pa.array(list(by_lang.values()), pa.int64())})
    parts = materialize(kept.where("part = 'block'").select("block").mapInArrow(_audit(group_table, lang_table, top_terms), "part string, lang string, source string, item string, value bigint"))

    # all pairs of a language's sources, as if no source held a term
    a = groups.withColumn("p0", F.when(F.col("base") > 0, _share(F.lit(0), F.col("base"))))
    b = a.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    exact = lambda c: c.cast("decimal(38,0)").alias("value")
    none = a.join(b, "lang").where("source <> item").select("lang", "source", "item", exact(F.coalesce(F.col("v") * _value(F.col("p0"), F.col("q0")), F.lit(0))))
    # terms that one of the two holds
    held = hold.join(a.select("lang", "source", "base", "p0"), ["lang", "source"]).select("lang", "source", "terms", "p0", _share(F.col("n"), F.col("base")).alias("p"))
    one = held.join(b, "lang").where("source <> item")
    first = one.select("lang", "source", "item", exact(F.col("terms") * (_value(F.col("p"), F.col("q0")) - _value(F.col("p0"), F.col("q0"))).cast("decimal(20,0)")))
    second = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), exact(F.col("terms") * (_value(F.col("q0"), F.col("p")) - _value(F.col("q0"), F.col("p0"))).cast("decimal(20,0)")))
    both = parts.where("part = 'pair'").select("lang", "source", "item", exact(F.col("value")))
    pairs = none.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = ranked(parts.where("part = 'term'"), "term").where(F.col("rank") <= top_terms)
    return ranked(pairs, "pair").unionByName(best)
