"""The registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions import strings as S
from keyweave.functions import tokens as T
from keyweave.functions.strings import Casing
from keyweave.operators import composite, discovery, equijoin, fuzzy, oracle, sampling, substring_match
from keyweave.plans import evaluate, methods
from keyweave.plans.derived import derived_join, one_direction, swapped
from keyweave.plans.program import Constant, Program, split_split_substr, split_substr, substr
from keyweave.sources import fixtures
from keyweave.sources.table import JoinTable, csv_lines
from keyweave.workers import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _cells(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("_cells", F.array(*[F.col(c).cast("string") for c in columns]))


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS head, string_split(o_orderpriority, '-')[2] AS tail FROM orders")
def split_select(spark, sf):
    parts = S.split(F.col("o_orderpriority"), "-")
    return _read(spark, sf, "orders").select("o_orderkey", S.select_k(parts, 0).alias("head"), S.select_k(parts, 1).alias("tail"))


@query("SELECT page_id, string_split(url, '/')[-1] AS last, string_split(url, '/')[10] AS tenth FROM pages")
def select_negative_oob(spark, sf):
    parts = S.split(F.col("url"), "/")
    return _read(spark, sf, "pages").select("page_id", S.select_k(parts, -1).alias("last"), S.select_k(parts, 9).alias("tenth"))


def _sql_substring(value: str, start: int, length: int) -> str:
    at = f"greatest(0, least({start if start >= 0 else f'length({value}) + {start}'}, length({value})))"
    return f"substring({value}, {at} + 1" + (f", {length})" if length >= 0 else ")")


_SUBSTRINGS = [(0, -1), (3, 4), (10, -1), (-3, -1), (-3, 2), (-40, 4), (40, 2), (2, 0)]


@query("SELECT p_partkey, " + ", ".join(f"{_sql_substring('p_name', s, n)} AS s{i}" for i, (s, n) in enumerate(_SUBSTRINGS)) + " FROM part")
def substring_clamped(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", *[S.substring(F.col("p_name"), s, n).alias(f"s{i}") for i, (s, n) in enumerate(_SUBSTRINGS)])


@query("SELECT o_orderkey, lower(o_orderpriority) AS low, upper(lower(o_orderpriority)) AS up FROM orders")
def casing_lower_upper(spark, sf):
    p = F.col("o_orderpriority")
    return _read(spark, sf, "orders").select("o_orderkey", S.cased(p, Casing.LOWER).alias("low"), S.cased(F.lower(p), Casing.UPPER).alias("up"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS title FROM part")
def casing_title(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", S.cased(F.col("p_name"), Casing.TITLE).alias("title"))


def _op(op, *columns: str, key: str, table: str) -> Query:
    return lambda spark, sf: _cells(_read(spark, sf, table), *columns).select(key, op.to_column(F.col("_cells")).alias("out"))


query("SELECT page_id, 'x-' AS out FROM pages", "op_constant")(_op(Constant("x-"), "url", key="page_id", table="pages"))
query("SELECT c_custkey, upper(substring(c_name, 1, 4)) AS out FROM customer", "op_substr")(_op(substr(0, 0, 4, Casing.UPPER), "c_name", key="c_custkey", table="customer"))
query("SELECT page_id, substring(string_split(url, '/')[3], 3, 5) AS out FROM pages", "op_split_substr")(_op(split_substr(0, "/", 2, 2, 5), "url", key="page_id", table="pages"))
query("SELECT page_id, string_split(string_split(url, '/')[3], '.')[2] AS out FROM pages", "op_split_split_substr")(_op(split_split_substr(0, "/", 2, ".", 1, 0), "url", key="page_id", table="pages"))

_PROGRAM = Program((Constant("["), split_substr(0, "#", 1, 0), Constant("] "), substr(1, 0, -1, Casing.LOWER)))


@query("SELECT c_custkey, '[' || string_split(c_name, '#')[2] || '] ' || lower(c_mktsegment) AS out FROM customer")
def program_apply(spark, sf):
    return _cells(_read(spark, sf, "customer"), "c_name", "c_mktsegment").select("c_custkey", _PROGRAM.to_column().alias("out"))


@query("SELECT page_id, string_split(url, '/')[8] || '!' AS out FROM pages")
def program_fails_to_null(spark, sf):
    return _cells(_read(spark, sf, "pages"), "url").select("page_id", Program((split_substr(0, "/", 7, 0), Constant("!"))).to_column().alias("out"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS out FROM part")
def key_concat(spark, sf):
    return _cells(_read(spark, sf, "part"), "p_name", "p_brand").select("p_partkey", S.join_cells(F.col("_cells"), [0, 1], "|").alias("out"))


@query("SELECT n_nationkey, n_nationkey || ' ' || n_name || ' ' || n_regionkey AS out FROM nation")
def full_row_concat(spark, sf):
    return _cells(_read(spark, sf, "nation"), "n_nationkey", "n_name", "n_regionkey").select("n_nationkey", S.whole_row(F.col("_cells")).alias("out"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS out FROM part")
def fingerprint(spark, sf):
    """The second use of a name stands for the second column with it."""
    df = _cells(_read(spark, sf, "part"), "p_brand", "p_name", "p_type")
    t = JoinTable(df.select(F.col("p_partkey").alias("_rid"), "_cells"), ["x", "name", "x"])
    return t.values(t.positions(["x", "x", "name"]), "|").select(F.col("_rid").alias("p_partkey"), F.col("value").alias("out"))


# --- equi-joins and aggregates ------------------------------------------------------------------------------------------


def _customers(spark, sf) -> JoinTable:
    return JoinTable.from_df(_read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"], "c_custkey", "customer")


_KEYED = "SELECT c_custkey AS _rid, 'C-' || substring(c_name, 10) AS value FROM customer UNION ALL SELECT c_custkey + 1000000000, 'C-' || substring(c_name, 10) FROM customer WHERE c_custkey % 10 = 0"
_KEY = Program((Constant("C-"), split_substr(0, "#", 1, 0)))


def _keyed(spark, sf) -> DataFrame:
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), F.concat(F.lit("C-"), F.expr("substring(c_name, 10)")).alias("value"))
    return c.unionByName(c.where(F.col("_rid") % 10 == 0).withColumn("_rid", F.col("_rid") + 1000000000))


@query(f"WITH t AS ({_KEYED}), u AS (SELECT value, min(_rid) AS tgt_rid FROM t GROUP BY value HAVING count(*) = 1) SELECT c_custkey AS src_rid, tgt_rid FROM customer JOIN u ON value = 'C-' || string_split(c_name, '#')[2]")
def transformed_equijoin(spark, sf):
    return equijoin.transformed_equijoin(_customers(spark, sf).df, _KEY.to_column(), _keyed(spark, sf))


@query(
    f"WITH t AS ({_KEYED}), u AS (SELECT value FROM t GROUP BY value HAVING count(*) = 1), k AS (SELECT 0 AS pid, 'C-' || string_split(c_name, '#')[2] AS value FROM customer UNION ALL SELECT 1, 'C-' || substring(c_name, 10, 8) FROM customer UNION ALL SELECT 2, 'C-00' || substring(c_name, 12) FROM customer), "
    "o AS (SELECT pid, value FROM k GROUP BY pid, value HAVING count(*) = 1) SELECT CAST(pid AS INTEGER) AS pid, count(*) AS score FROM o JOIN u USING (value) GROUP BY pid"
)
def injective_score(spark, sf):
    programs = [(0, _KEY), (0, Program((Constant("C-"), substr(0, 9, 8)))), (0, Program((Constant("C-00"), substr(0, 11))))]
    return equijoin.injective_scores(_customers(spark, sf).df, programs, _keyed(spark, sf).withColumn("tcol", F.lit(0)))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def value_frequency(spark, sf):
    return equijoin.value_frequency(_read(spark, sf, "part").select(F.col("p_name").alias("value")))


@query("SELECT p_name AS value, min(p_partkey) AS first_rid FROM part GROUP BY p_name")
def first_row_per_value(spark, sf):
    return equijoin.first_row_per_value(_read(spark, sf, "part").select(F.col("p_name").alias("value"), F.col("p_partkey").alias("_rid")))


@query("WITH t AS (SELECT p_type AS value, min(p_partkey) AS tgt_rid FROM part GROUP BY p_type) SELECT p_partkey AS src_rid, tgt_rid FROM part JOIN t ON value = p_type")
def first_match_join(spark, sf):
    p = _read(spark, sf, "part").withColumnRenamed("p_partkey", "_rid")
    return equijoin.first_match_join(p, F.col("p_type"), p.select("_rid", F.col("p_type").alias("value")))


# --- samples ------------------------------------------------------------------------------------------------------------

_SIZE = "CAST(CASE WHEN sqrt(4.0 * {o} / ((1 - 0.8) * 0.1)) >= {n} THEN {n} ELSE ceil({n} * (1.0 / {n} * sqrt(4.0 * {o} / ((1 - 0.8) * 0.1)))) END AS BIGINT)"


@query(f"SELECT {_SIZE.format(n='c.n', o='o.n')} AS customers, {_SIZE.format(n='o.n', o='c.n')} AS orders FROM (SELECT count(*) AS n FROM customer) c, (SELECT count(*) AS n FROM orders) o")
def sample_size(spark, sf):
    n, m = (_read(spark, sf, t).count() for t in ("customer", "orders"))
    return spark.createDataFrame([(sampling.sample_size(n, m), sampling.sample_size(m, n))], "customers long, orders long")


@query("WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT " + _SIZE.format(n="n", o="n") + " AS k FROM n) SELECT o_orderkey AS _rid, o_orderpriority FROM orders QUALIFY row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) <= (SELECT k FROM k)")
def sample_rows(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("_rid"), "o_orderpriority")
    n = o.count()
    return sampling.draw(o, sampling.sample_size(n, n))


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), w AS (SELECT max(n) AS n, least(max(n), greatest(20, least(400, ceil(max(n) * 0.1)))) AS k FROM r) SELECT c_custkey AS _rid FROM r, w WHERE pos IN (SELECT CAST(floor(i * (w.n / w.k)) AS BIGINT) FROM range(CAST((SELECT k FROM w) AS BIGINT)) t(i), w)")
def interleaved_sample(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"))
    return sampling.interleaved(c, c.count())


# --- q-grams ------------------------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT n_name AS v FROM nation), s AS (SELECT substring(v, i) AS suffix FROM v, range(1, 100) t(i) WHERE i <= length(v)) SELECT suffix, count(*) AS n FROM s GROUP BY suffix")
def suffix_counts(spark, sf):
    return discovery.suffixes(_read(spark, sf, "nation").select(F.col("n_name").alias("v"))).groupBy("suffix").agg(F.count("*").alias("n"))


def _sql_grams(source: str) -> str:
    """Columns of source and pos, size, gram; source has v."""
    return f"SELECT s.*, a.pos, z.size, substring(v, a.pos, z.size) AS gram FROM ({source}) s, range(1, 200) a(pos), range(3, 200) z(size) WHERE a.pos + z.size - 1 <= length(v)"


@query(f"WITH a AS ({_sql_grams('SELECT n_name AS v FROM nation')}), b AS ({_sql_grams('SELECT s_name AS v FROM supplier UNION ALL SELECT n_name FROM nation')}) SELECT gram, n, m FROM (SELECT gram, count(*) AS n FROM a GROUP BY gram) JOIN (SELECT gram, count(*) AS m FROM b GROUP BY gram) USING (gram)")
def qgram_match_counts(spark, sf):
    n = _read(spark, sf, "nation").select(F.col("n_name").alias("v"))
    s = _read(spark, sf, "supplier").select(F.col("s_name").alias("v")).unionByName(n)
    count = lambda df, c: discovery.grams(df).groupBy("gram").agg(F.count("*").alias(c))
    return count(n, "n").join(count(s, "m"), "gram")


_TAGS = "SELECT s_suppkey AS _rid, '[' || substring(s_name, 10) || '] nation ' || s_nationkey AS v FROM supplier"
_NAMES = "SELECT s_suppkey AS _rid, s_name AS v FROM supplier"
_OPTIMAL = f"""sg AS (SELECT gram, count(*) AS n FROM ({_sql_grams(_NAMES)}) GROUP BY gram), tg AS (SELECT gram, count(*) AS m, min(_rid) AS tgt_rid FROM ({_sql_grams(_TAGS)}) GROUP BY gram),
h AS (SELECT v, pos, size, gram, m, tgt_rid FROM ({_sql_grams(f'SELECT DISTINCT v FROM ({_NAMES})')}) JOIN tg USING (gram)), l AS (SELECT v, pos, gram, m, tgt_rid FROM h QUALIFY row_number() OVER (PARTITION BY v, pos ORDER BY size DESC) = 1),
best AS (SELECT v, gram, 1.0 / (n * m) AS score, n, m, tgt_rid FROM l JOIN sg USING (gram) QUALIFY row_number() OVER (PARTITION BY v ORDER BY 1.0 / (n * m) DESC, pos) = 1)"""


def _tagged(spark, sf) -> tuple[JoinTable, JoinTable]:
    s = _read(spark, sf, "supplier")
    tag = F.concat(F.lit("["), F.expr("substring(s_name, 10)"), F.lit("] nation "), F.col("s_nationkey").cast("string"))
    return JoinTable.from_df(s.select("s_suppkey", "s_name"), ["s_name"], "s_suppkey", "names"), JoinTable.from_df(s.select("s_suppkey", tag.alias("tag")), ["tag"], "s_suppkey", "tags")


@query(f"WITH {_OPTIMAL} SELECT v, gram, CAST(score AS DOUBLE) AS score, n, m FROM best")
def optimal_qgram(spark, sf):
    s, t = _tagged(spark, sf)
    return discovery.optimal_grams(s.melted(), t.melted()).select("v", "gram", "score", "n", "m")


@query(f"WITH {_OPTIMAL} SELECT _rid AS src_rid, tgt_rid, gram FROM best JOIN ({_NAMES}) USING (v) WHERE n * m <= 1")
def joinable_pairs(spark, sf):
    return discovery.joinable_pairs(*_tagged(spark, sf)).select("src_rid", "tgt_rid", "gram")


@query(f"WITH {_OPTIMAL} SELECT 0 AS scol, 0 AS tcol, count(*) AS matches, CAST(avg(score) AS DOUBLE) AS mean_score FROM best WHERE n * m <= 1")
def discover_groups(spark, sf):
    return discovery.groups(discovery.joinable_pairs(*_tagged(spark, sf)))


_REMARKS = "SELECT s_suppkey AS _rid, CASE WHEN s_suppkey % 20 = 0 THEN substring(s_name, 10) ELSE md5(s_name) END AS v FROM supplier"
_OF_REMARKS = _OPTIMAL.replace(_NAMES, _REMARKS)


@query(f"WITH a AS (WITH {_OPTIMAL} SELECT 0 AS scol, score FROM best WHERE n * m <= 1), b AS (WITH {_OF_REMARKS} SELECT 1 AS scol, score FROM best WHERE n * m <= 1), g AS (SELECT scol, 0 AS tcol, count(*) AS matches, CAST(avg(score) AS DOUBLE) AS mean_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY scol) SELECT * FROM g WHERE matches * 10 >= (SELECT max(matches) FROM g)")
def groups_pruned(spark, sf):
    """A column that few rows match through goes, beside one that all match through."""
    _, t = _tagged(spark, sf)
    s = _read(spark, sf, "supplier")
    remark = F.when(F.col("s_suppkey") % 20 == 0, F.expr("substring(s_name, 10)")).otherwise(F.md5("s_name"))
    source = JoinTable.from_df(s.select("s_suppkey", "s_name", remark.alias("remark")), ["s_name"], "s_suppkey", "names")
    return discovery.groups(discovery.joinable_pairs(source, t))


@query(f"WITH {_OPTIMAL} SELECT _rid AS src_rid, tgt_rid, row_number() OVER (ORDER BY length(gram) DESC, _rid) AS place FROM best JOIN ({_NAMES}) USING (v) WHERE n * m <= 1")
def ordered_pairs(spark, sf):
    """The place of each match in its column pair: score, length of the gram, source row."""
    return discovery.joinable_pairs(*_tagged(spark, sf)).select("src_rid", "tgt_rid", F.col("place").cast("long").alias("place"))


@query(f"WITH {_OPTIMAL} SELECT DISTINCT g._rid AS src_rid, tgt_rid FROM best JOIN ({_sql_grams(_NAMES)}) g USING (gram) WHERE m = 1 AND n = 1")
def dq_p(spark, sf):
    return methods.METHODS["DQ-P"](*_tagged(spark, sf))


@query(f"WITH {_OPTIMAL} SELECT DISTINCT g._rid AS src_rid, tgt_rid FROM best JOIN ({_sql_grams(_NAMES)}) g USING (gram) WHERE m = 1")
def dq_r(spark, sf):
    return methods.METHODS["DQ-R"](*_tagged(spark, sf))


# --- tokenisers and distances -------------------------------------------------------------------------------------------


def _sql_qgrams(v: str, q: int) -> str:
    return f"CASE WHEN length({v}) < {q} THEN [{v}] ELSE list_distinct(list_transform(range(1, length({v}) - {q} + 2), lambda i: substring({v}, i, {q}))) END"


def _sql_parts(v: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({v}, '\\s+'), lambda x: x <> ''))"


def _sql_tokens(name: str, v: str) -> str:
    if name in ("q2", "q3"):
        return _sql_qgrams(v, int(name[1]))
    if name.startswith("Q"):
        q = int(name[1:])
        pad = "$" * (q - 1)
        return _sql_qgrams(f"('{pad}' || regexp_replace(lower({v}), '\\s', '{pad}', 'g') || '{pad}')", q)
    return {"word": _sql_parts(v), "EXACT": f"[{v}]", "LOWER": f"[lower({v})]", "SPLIT": _sql_parts(f"lower({v})"), "WORD": _sql_parts(f"regexp_replace(lower({v}), '[^a-z0-9]+', ' ', 'g')")}[name]


def _tokeniser(name: str) -> Query:
    value = lambda: F.concat_ws(" ", "p_name", "p_brand")  # noqa: E731  columns need a session
    return lambda spark, sf: _read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(T.tokenise(value(), name)), "~").alias("tokens"))


for _label, _name in {"tok_q2": "q2", "tok_q3": "q3", "tok_word": "word", "tok_exact": "EXACT", "tok_lower": "LOWER", "tok_split": "SPLIT", "tok_wordalnum": "WORD", "tok_qpad": "Q3", "tok_qpad10": "Q10"}.items():
    _value = "(p_name || ' ' || p_brand)"
    query(f"SELECT p_partkey, array_to_string(list_sort({_sql_tokens(_name, _value)}), '~') AS tokens FROM part", _label)(_tokeniser(_name))

_SQL_DISTANCE = {"JACCARD": "1 - i / (a + b - i)", "DICE": "1 - 2 * i / (a + b)", "MAXINCLUSION": "1 - i / least(a, b)", "INTERSECT": "1 / (1 + i)"}


def _distance(name: str) -> Query:
    def run(spark, sf):
        d = T.sets_distance(name, T.qgrams(F.lower("p_name"), 2), T.qgrams(F.lower("p_type"), 2))
        return _read(spark, sf, "part").select("p_partkey", F.round(d, 6).alias("d"))

    return run


for _label, _name in {"dist_jaccard": "JACCARD", "dist_dice": "DICE", "dist_maxinc": "MAXINCLUSION", "dist_intersect": "INTERSECT"}.items():
    query(
        f"WITH p AS (SELECT p_partkey, {_sql_qgrams('lower(p_name)', 2)} AS x, {_sql_qgrams('lower(p_type)', 2)} AS y FROM part), "
        f"s AS (SELECT p_partkey, CAST(length(list_intersect(x, y)) AS DOUBLE) AS i, length(x) AS a, length(y) AS b FROM p) SELECT p_partkey, round({_SQL_DISTANCE[_name]}, 6) AS d FROM s",
        _label,
    )(_distance(_name))


@query("SELECT x, y, CAST(d AS DOUBLE) AS d FROM (VALUES ('', ' ', 0.0), ('', 'a', 1.0), ('a b', 'a b', 0.0), ('a b', 'b c', 0.666667), ('a', 'b', 1.0)) t(x, y, d)")
def dist_blank_aware(spark, sf):
    df = spark.createDataFrame([("", " "), ("", "a"), ("a b", "a b"), ("a b", "b c"), ("a", "b")], "x string, y string")
    x, y = F.col("x"), F.col("y")
    return df.select("x", "y", F.round(T.blank_aware_jaccard(x, y, T.words(x), T.words(y)), 6).alias("d"))


# --- fuzzy joins --------------------------------------------------------------------------------------------------------

_CODES = "SELECT s_suppkey AS _rid, substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 12) AS value FROM supplier"
_NOISY = "SELECT s_suppkey AS _rid, substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 12) || CASE WHEN s_suppkey % 10 = 0 THEN ' x' ELSE '' END AS value FROM supplier WHERE s_suppkey % 7 <> 0"
_PARTS = "SELECT p_partkey AS _rid, p_name AS value FROM part"
_LOUD = "SELECT p_partkey AS _rid, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' s' ELSE 'es' END AS value FROM part"


def _codes(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = _read(spark, sf, "supplier")
    code = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12)
    noisy = F.concat(code, F.when(F.col("s_suppkey") % 10 == 0, " x").otherwise(""))
    return s.select(F.col("s_suppkey").alias("_rid"), code.alias("value")), s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("_rid"), noisy.alias("value"))


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = _read(spark, sf, "part")
    loud = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " s").otherwise("es"))
    return p.select(F.col("p_partkey").alias("_rid"), F.col("p_name").alias("value")), p.select(F.col("p_partkey").alias("_rid"), loud.alias("value"))


def _sql_fuzzy(source: str, target: str, tok: str) -> str:
    """Common table expressions s, t (distinct values), d (distances below 1) and best (nearest target value)."""
    return f"""s AS (SELECT value AS s, min(_rid) AS s_first, {_sql_tokens(tok, 'value')} AS x FROM ({source}) GROUP BY value), t AS (SELECT value AS t, min(_rid) AS t_first, count(*) AS t_rows, {_sql_tokens(tok, 'value')} AS y FROM ({target}) GROUP BY value),
d AS (SELECT * FROM (SELECT s, t, s_first, t_first, t_rows, CASE WHEN s = t THEN 0.0 ELSE 1 - CAST(length(list_intersect(x, y)) AS DOUBLE) / (length(x) + length(y) - length(list_intersect(x, y))) END AS d FROM s, t) WHERE d < 1),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, t_first) = 1),
top1 AS (SELECT CASE WHEN min(d) IS NULL THEN 1023 / 1024 ELSE greatest(0, least(1023, ceil(min(d) * 1024) - 1)) / 1024 END AS threshold FROM (SELECT d FROM best QUALIFY row_number() OVER (PARTITION BY t ORDER BY d, s_first) = 2)),
rec AS (SELECT CASE WHEN min(d) IS NULL THEN 1023 / 1024 ELSE greatest(0, least(1023, ceil(min(d) * 1024) - 1)) / 1024 END AS threshold FROM (SELECT d, sum(t_rows) OVER (PARTITION BY s ORDER BY d, t_first ROWS UNBOUNDED PRECEDING) AS rows FROM d) WHERE rows >= 2)"""


def _distances(spark, sf, data, tok) -> DataFrame:
    s, t = data(spark, sf)
    return fuzzy.token_distances(fuzzy.distinct_values(s), fuzzy.distinct_values(t), tok)


@query(f"WITH {_sql_fuzzy(_PARTS, _LOUD, 'q3')} SELECT s, t, round(d, 6) AS d FROM d")
def token_distances(spark, sf):
    return _distances(spark, sf, _parts, "q3").select("s", "t", F.round("d", 6).alias("d"))


@query(f"WITH {_sql_fuzzy(_PARTS, _LOUD, 'q3')} SELECT s, t, t_first, round(d, 6) AS d FROM best")
def nearest_top1(spark, sf):
    return fuzzy.nearest(_distances(spark, sf, _parts, "q3")).select("s", "t", "t_first", F.round("d", 6).alias("d"))


@query(f"WITH {_sql_fuzzy(_PARTS, _LOUD, 'q3')} SELECT CAST(threshold AS DOUBLE) AS threshold FROM top1")
def threshold_top1(spark, sf):
    return fuzzy.top1_threshold(fuzzy.nearest(_distances(spark, sf, _parts, "q3")))


@query(f"WITH {_sql_fuzzy(_CODES, _NOISY, 'q2')} SELECT CAST(threshold AS DOUBLE) AS threshold FROM rec")
def threshold_recovery(spark, sf):
    s, t = (fuzzy.distinct_values(x).persist() for x in _codes(spark, sf))
    return spark.createDataFrame([(fuzzy.closed(fuzzy.Tokens(s, t, "q2").crowded()),)], "threshold double")


@query(f"WITH {_sql_fuzzy(_PARTS, _LOUD, 'word')}, k AS (SELECT s, t_first, d FROM best, top1 WHERE d <= threshold) SELECT _rid AS src_rid, t_first AS tgt_rid, round(d, 6) AS distance FROM ({_PARTS}) r JOIN k ON s = value")
def top1_fuzzy_word(spark, sf):
    return fuzzy.top1_join(*_parts(spark, sf), ("word",)).withColumn("distance", F.round("distance", 6))


def _coded_tables(spark, sf) -> tuple[JoinTable, JoinTable]:
    table = lambda df, n: JoinTable(df.select("_rid", F.array("value").alias("_cells")), ["code"], [0], n)
    s, t = _codes(spark, sf)
    return table(s, "codes"), table(t, "noisy")


_TRUE = f"SELECT c._rid AS src_rid, n._rid AS tgt_rid FROM ({_CODES}) c JOIN ({_NOISY}) n ON starts_with(n.value, c.value)"


def _sql_top1(source: str, target: str) -> str:
    """The join on the nearest values under the tokeniser that covers most target rows, the first among equals."""
    tried = " UNION ALL ".join(f"SELECT {i} AS o, * FROM (WITH {_sql_fuzzy(source, target, k)} SELECT s, t_first FROM best, top1 WHERE d <= threshold)" for i, k in enumerate(T.JOIN_TOKENISERS))
    return f"WITH k AS ({tried}), c AS (SELECT o FROM k GROUP BY o ORDER BY count(DISTINCT t_first) DESC, o LIMIT 1) SELECT r._rid AS src_rid, t_first AS tgt_rid FROM ({source}) r JOIN k ON s = value JOIN c USING (o)"


def _wide(rows: str) -> str:
    return f"SELECT _rid, value || ' nation ' || s_nationkey AS value FROM ({rows}) JOIN supplier ON s_suppkey = _rid"


@query(_sql_top1(_CODES, _NOISY))
def fj_c(spark, sf):
    return methods.METHODS["FJ-C"](*_coded_tables(spark, sf))


@query(_sql_top1(_wide(_CODES), _wide(_NOISY)))
def fj_fr(spark, sf):
    """Whole rows of two columns are compared, the second of which many rows share."""
    n = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("_rid"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("nation"))
    table = lambda df, name: JoinTable(df.join(n, "_rid").select("_rid", F.array("value", "nation").alias("_cells")), ["code", "nation"], [0], name)
    s, t = _codes(spark, sf)
    return methods.METHODS["FJ-FR"](table(s, "codes"), table(t, "noisy"))


_UNMATCHED = f"""u AS (SELECT c._rid AS src_rid, c.value AS s FROM ({_CODES}) c WHERE NOT EXISTS (SELECT 1 FROM ({_NOISY}) n WHERE n.value = c.value)), v AS (SELECT n.value AS t, min(n._rid) AS tgt_rid FROM ({_NOISY}) n WHERE NOT EXISTS (SELECT 1 FROM ({_CODES}) c WHERE n.value = c.value) GROUP BY n.value)"""


@query(f"WITH {_sql_fuzzy(_CODES, _NOISY, 'q3')}, {_UNMATCHED} SELECT src_rid, v.tgt_rid, round(d, 6) AS distance FROM d JOIN v USING (t) JOIN u USING (s), rec WHERE d <= threshold AND threshold > 0 QUALIFY row_number() OVER (PARTITION BY src_rid ORDER BY d, v.tgt_rid) = 1")
def fuzzy_recovery(spark, sf):
    s, t = _codes(spark, sf)
    equal = s.join(t.select(F.col("_rid").alias("tgt_rid"), "value"), "value")
    pairs, _, _ = fuzzy.recover(s, t, equal.select("_rid").distinct(), equal.select(F.col("tgt_rid").alias("_rid")).distinct(), ("q3",))
    return pairs.withColumn("distance", F.round("distance", 6))


_PLAIN = "SELECT p_partkey AS _rid, p_name AS value FROM part"
_BRANDED = "SELECT p_partkey AS _rid, upper(p_name) || ' ' || p_brand AS value FROM part"


def _branded(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = _read(spark, sf, "part").withColumnRenamed("p_partkey", "_rid")
    return p.select("_rid", F.col("p_name").alias("value")), p.select("_rid", F.concat(F.upper("p_name"), F.lit(" "), "p_brand").alias("value"))


def _sql_grid(tokenisers: tuple[str, ...]) -> str:
    """near: the nearest target row of each source row under each tokeniser and distance; equal values are compared once."""
    once = lambda rows: f"SELECT value, min(_rid) AS _rid FROM ({rows}) GROUP BY value"
    met = " UNION ALL ".join(f"SELECT '{k}' AS tok, s.value, t._rid AS tgt_rid, CAST(length(list_intersect(x, y)) AS DOUBLE) AS i, length(x) AS a, length(y) AS b FROM (SELECT *, {_sql_tokens(k, 'value')} AS x FROM ({once(_PLAIN)})) s, (SELECT *, {_sql_tokens(k, 'value')} AS y FROM ({once(_BRANDED)})) t" for k in tokenisers)
    each = " UNION ALL ".join(f"SELECT tok, '{n}' AS dist, value, tgt_rid, {e} AS d FROM g" for n, e in _SQL_DISTANCE.items())
    return f"WITH g AS ({met}), e AS ({each}), v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY tok, dist, value ORDER BY d, tgt_rid) = 1), near AS (SELECT tok, dist, _rid AS src_rid, tgt_rid, d FROM ({_PLAIN}) JOIN v USING (value))"


_NEAREST = _sql_grid(T.GRID_TOKENISERS)
_GRID = "SELECT tok, dist, CAST(h / 10 AS DOUBLE) AS threshold, src_rid, tgt_rid FROM near, range(1, 11) t(h) WHERE d <= CASE WHEN dist = 'INTERSECT' THEN 1.0 / (1 + h) + 1e-12 ELSE h / 10 END"


@query(f"{_sql_grid(('WORD',))} SELECT src_rid, tgt_rid FROM near WHERE dist = 'JACCARD' AND d <= 0.5")
def fjo_standalone(spark, sf):
    table = lambda df, name: JoinTable(df.select("_rid", F.array("value").alias("_cells")), ["name"], [0], name)
    s, t = _branded(spark, sf)
    return methods.METHODS["FJ-O"](table(s, "parts"), table(t, "branded"))


@query(f"{_NEAREST} SELECT tok, dist, src_rid, tgt_rid, round(d, 6) AS d FROM near")
def fjo_nearest(spark, sf):
    return oracle.nearest_rows(*_branded(spark, sf)).select("tok", "dist", "src_rid", "tgt_rid", F.round("d", 6).alias("d"))


@query(f"{_NEAREST}, p AS ({_GRID}) SELECT tok, dist, threshold, count(*) AS pairs FROM p GROUP BY ALL")
def fjo_grid(spark, sf):
    pairs = oracle.pairs_at(oracle.nearest_rows(*_branded(spark, sf)))
    return pairs.groupBy("tok", "dist", "threshold").agg(F.count("*").alias("pairs"))


_PLACES = f"list_position({list(T.GRID_TOKENISERS)!r}, tok), list_position({list(T.GRID_DISTANCES)!r}, dist), threshold"


@query(f"{_NEAREST}, p AS ({_GRID}), f AS (SELECT tok, dist, threshold, 2 * count(*) FILTER (WHERE src_rid = tgt_rid) / (count(*) + (SELECT count(*) FROM part)) AS f FROM p GROUP BY ALL) SELECT tok, dist, threshold, f FROM f ORDER BY f DESC, {_PLACES} LIMIT 1")
def fjo_grid_best(spark, sf):
    s, t = _branded(spark, sf)
    truth = s.select(F.col("_rid").alias("src_rid"), F.col("_rid").alias("tgt_rid"))
    return oracle.best_setting(s, t, truth)


@query(
    f"WITH s AS ({_PARTS}), t AS ({_LOUD}), n AS (SELECT count(*) AS n FROM t), tg AS (SELECT DISTINCT _rid AS tgt_rid, unnest({_sql_tokens('q3', 'value')}) AS gram FROM t), w AS (SELECT gram, pow(log2(n / count(*)), 2) AS w FROM tg, n GROUP BY gram, n), "
    f"sg AS (SELECT DISTINCT _rid AS src_rid, unnest({_sql_tokens('q3', 'value')}) AS gram FROM s), x AS (SELECT src_rid, tgt_rid, round(sum(w), 9) AS score FROM sg JOIN w USING (gram) JOIN tg USING (gram) GROUP BY ALL) SELECT src_rid, tgt_rid, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY src_rid ORDER BY score DESC, tgt_rid) <= 5"
)
def tfidf_top5(spark, sf):
    s, t = _parts(spark, sf)
    return substring_match.rare_gram_matches(s, t).select("src_rid", "tgt_rid", F.round("score", 6).alias("score"))


@query("SELECT s_suppkey AS _rid, substring(s_name, 1, 3) || '-' || substring(s_name, 10) AS value FROM supplier")
def sm_formula_apply(spark, sf):
    pieces = [substring_match.Copy(0, 0, 3), substring_match.Literal("-"), substring_match.Copy(0, 9)]
    return _cells(_read(spark, sf, "supplier"), "s_name").select(F.col("s_suppkey").alias("_rid"), substring_match.formula_column(pieces).alias("value"))


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier")
def sm_formula_join(spark, sf):
    s = _read(spark, sf, "supplier")
    code = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12)
    source = JoinTable.from_df(s.select("s_suppkey", code.alias("first"), F.substring(F.md5(F.col("s_name")), 1, 10).alias("last")), [], "s_suppkey")
    login = F.concat(F.substring(code, 1, 1), F.lit("."), F.substring(F.md5(F.col("s_name")), 1, 10))
    target = JoinTable.from_df(s.select("s_suppkey", login.alias("login")), ["login"], "s_suppkey")
    return methods.METHODS["SM"](source, target)


# --- the whole join -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS src_rid, c_custkey AS tgt_rid FROM customer")
def aj_equality(spark, sf):
    """Learns lower(segment) + '-' + digits from name and segment, and joins on it."""
    s = _customers(spark, sf)
    key = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.expr("substring(c_name, 10)"))
    t = JoinTable.from_df(_read(spark, sf, "customer").select("c_custkey", key.alias("tag")), ["tag"], "c_custkey", "tags")
    return methods.METHODS["AJ-E"](s, t)


def _emails(spark, sf) -> tuple[JoinTable, JoinTable]:
    s = _read(spark, sf, "supplier")
    code = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12)
    mail = F.concat(F.when(F.col("s_suppkey") % 10 == 0, "0").otherwise(""), code, F.lit("@n"), F.col("s_nationkey").cast("string"), F.lit(".example.com"))
    return JoinTable.from_df(s.select("s_suppkey", code.alias("code"), "s_nationkey"), ["code"], "s_suppkey", "codes"), JoinTable.from_df(s.select("s_suppkey", mail.alias("mail")), ["mail"], "s_suppkey", "mails")


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier")
def aj_full(spark, sf):
    """Nine rows in ten join on the learned address, the tenth has a typing error and is recovered."""
    return derived_join(*_emails(spark, sf)).pairs


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier WHERE s_suppkey % 10 <> 0")
def aj_without_recovery(spark, sf):
    return derived_join(*_emails(spark, sf), fuzzy=False).pairs


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier")
def aj_composite(spark, sf):
    """Both keys hold a name and a remark in brackets; only the split names can be derived from each other."""
    s = _read(spark, sf, "supplier")
    word = lambda c, i: F.initcap(F.translate(F.substring(F.md5(F.concat(F.col(c).cast("string"), F.lit(i))), 1, 7), "0123456789", "ghijklmnop"))
    first, last = word("s_suppkey", "a"), word("s_suppkey", "b")
    a = F.concat(first, F.lit(" "), last, F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")"))
    b = F.concat(last, F.lit(", "), first, F.lit(" (1"), F.lpad((F.col("s_suppkey") % 7 * 131).cast("string"), 3, "9"), F.lit("-)"))
    return derived_join(JoinTable.from_df(s.select("s_suppkey", a.alias("who")), ["who"], "s_suppkey"), JoinTable.from_df(s.select("s_suppkey", b.alias("name")), ["name"], "s_suppkey")).pairs


_GARBLED = "SELECT s_suppkey AS _rid, substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 12) || '~' || substring(md5('x' || s_suppkey), 1, 1) || '~' || substring(md5(CAST(s_suppkey AS VARCHAR)), 13, 12) AS value FROM supplier"
_WHOLE = "SELECT s_suppkey AS _rid, substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 24) AS value FROM supplier"


@query(f"WITH {_sql_fuzzy(_WHOLE, _GARBLED, 'q3')} SELECT s_first AS src_rid, t_first AS tgt_rid FROM best, rec WHERE d <= threshold AND threshold > 0")
def fuzzy_only_fallback(spark, sf):
    """No program makes the letter in the middle, so the raw values are joined."""
    s = _read(spark, sf, "supplier")
    code, odd = F.md5(F.col("s_suppkey").cast("string")), F.substring(F.md5(F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))), 1, 1)
    source = JoinTable.from_df(s.select("s_suppkey", F.substring(code, 1, 24).alias("code")), ["code"], "s_suppkey", "codes")
    garbled = F.concat(F.substring(code, 1, 12), F.lit("~"), odd, F.lit("~"), F.substring(code, 13, 12))
    target = JoinTable.from_df(s.select("s_suppkey", garbled.alias("garbled")), ["garbled"], "s_suppkey", "garbled")
    return one_direction(source, target).pairs


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier")
def learn_prefix_of_mixed_lengths(spark, sf):
    """The key is the first four letters of names of two letters and more, and a number."""
    s = _read(spark, sf, "supplier")
    word = F.translate(F.expr("substring(md5(s_name), 1, int(s_suppkey % 8 + 2))"), "0123456789", "ghijklmnop")
    source = JoinTable.from_df(s.select("s_suppkey", word.alias("word"), F.expr("substring(s_name, 10)").alias("number")), [], "s_suppkey", "names")
    key = F.concat(F.substring(word, 1, 4), F.lit("/"), F.expr("substring(s_name, 10)"))
    return methods.METHODS["AJ-E"](source, JoinTable.from_df(s.select("s_suppkey", key.alias("key")), ["key"], "s_suppkey", "keys"))


@query("SELECT s_suppkey AS src_rid, s_suppkey AS tgt_rid FROM supplier")
def learn_split_casing(spark, sf):
    """The key is a part of a part of the source's column, and the beginning of another in capitals."""
    s = _read(spark, sf, "supplier")
    number, code = F.expr("substring(s_name, 10)"), F.translate(F.substring(F.md5("s_name"), 1, 8), "0123456789", "ghijklmnop")
    source = JoinTable.from_df(s.select("s_suppkey", F.concat(F.lit("id:"), number, F.lit(","), code, F.lit(":z")).alias("x")), ["x"], "s_suppkey", "x")
    key = F.concat(number, F.lit("-"), F.upper(F.substring(code, 1, 3)))
    return methods.METHODS["AJ-E"](source, JoinTable.from_df(s.select("s_suppkey", key.alias("key")), ["key"], "s_suppkey", "keys"))


@query("SELECT p_partkey, p_type, trim(string_split(p_type, ' ')[1]) AS part0 FROM part")
def composite_split(spark, sf):
    """p_type with a remark in brackets gets its two parts as columns of their own."""
    p = _read(spark, sf, "part")
    t = JoinTable.from_df(p.select("p_partkey", F.concat(F.split("p_type", " ")[0], F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("x"), "p_type"), ["x"], "p_partkey")
    wide = composite.split_keys(t)
    return wide.df.select(F.col("_rid").alias("p_partkey"), F.get("_cells", F.lit(1)).alias("p_type"), F.get("_cells", F.lit(2)).alias("part0"))


@query("SELECT n_regionkey AS src_rid, CAST(n_nationkey AS BIGINT) AS tgt_rid FROM nation")
def direction_swap(spark, sf):
    return swapped(_read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src_rid"), F.col("n_regionkey").alias("tgt_rid")))


@query("SELECT count(*) AS matched, CAST(0 AS BIGINT) AS unmatched FROM supplier")
def trace_application(spark, sf):
    result = one_direction(*reversed(_tagged(spark, sf)))
    return spark.createDataFrame([(result.trace["application"]["matched"], result.trace["application"]["unmatched"])], "matched long, unmatched long")


# --- evaluation ---------------------------------------------------------------------------------------------------------

_RUN = {
    "pair_id": "o_orderpriority",
    "method": "concat(o_orderstatus, o_orderkey % 7)",
    "seq": "o_orderkey",
    "joined": "o_orderkey % 3",
    "precision": "(o_orderkey * 31 % 101) / CAST(128 AS DOUBLE)",
    "recall": "(o_orderkey * 17 % 97) / CAST(128 AS DOUBLE)",
    "ms": "o_orderkey * 7919 % 10007 / CAST(16 AS DOUBLE)",
}
_RUNS_SQL = "(SELECT " + ", ".join(f"{'CAST(' + e + ' AS DOUBLE)' if n in ('precision', 'recall', 'ms') else e} AS {n}" for n, e in _RUN.items()) + " FROM orders) r"


def _runs(spark, sf) -> DataFrame:
    """Runs as the result store holds them, made from orders."""
    return _read(spark, sf, "orders").selectExpr(*[f"cast({e} as double) as {n}" if n in ("precision", "recall", "ms") else f"{e} as {n}" for n, e in _RUN.items()])


_PRODUCED = f"SELECT CAST(c._rid AS VARCHAR) AS src_fp, CAST(n._rid AS VARCHAR) AS tgt_fp FROM ({_CODES}) c JOIN ({_NOISY}) n ON left(n.value, 2) = left(c.value, 2)"
_TRUTH = "SELECT CAST(s_suppkey AS VARCHAR) AS src_fp, CAST(s_suppkey AS VARCHAR) AS tgt_fp FROM supplier WHERE s_suppkey % 3 > 0"


def _produced(spark, sf) -> tuple[DataFrame, DataFrame]:
    s, t = _codes(spark, sf)
    text = lambda c, n: F.col(c).cast("string").alias(n)
    a, b = s.select(text("_rid", "src_fp"), F.substring("value", 1, 2).alias("k")), t.select(text("_rid", "tgt_fp"), F.substring("value", 1, 2).alias("k"))
    return equijoin.many_to_many(a, b, "k").select("src_fp", "tgt_fp"), s.where("_rid % 3 > 0").select(text("_rid", "src_fp"), text("_rid", "tgt_fp"))


@query(f"WITH p AS (SELECT DISTINCT * FROM ({_PRODUCED})), t AS ({_TRUTH}), c AS (SELECT (SELECT count(*) FROM p) AS produced, (SELECT count(*) FROM t) AS truths, (SELECT count(*) FROM p JOIN t USING (src_fp, tgt_fp)) AS tp), s AS (SELECT *, tp / produced AS p, tp / truths AS r FROM c) SELECT produced, truths, tp AS true_positives, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f FROM s")
def precision_recall(spark, sf):
    out = evaluate.scores(*_produced(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f")})


@query(f"WITH p AS (SELECT DISTINCT * FROM ({_PRODUCED})), t AS ({_TRUTH}) SELECT p.src_fp, p.tgt_fp, t.tgt_fp AS expected FROM p LEFT JOIN t ON p.src_fp = t.src_fp WHERE t.tgt_fp IS NULL OR t.tgt_fp <> p.tgt_fp")
def mismatches(spark, sf):
    return evaluate.mismatches(*_produced(spark, sf))


@query(f"WITH a AS (SELECT method, coalesce(avg(precision) FILTER (WHERE joined > 0), 0) AS precision, avg(recall) AS recall FROM {_RUNS_SQL} GROUP BY method) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM a")
def method_averages(spark, sf):
    return evaluate.method_averages(_runs(spark, sf))


@query(f"SELECT * FROM {_RUNS_SQL} QUALIFY row_number() OVER (PARTITION BY pair_id, method ORDER BY seq DESC) = 1")
def latest_run(spark, sf):
    return evaluate.latest_runs(_runs(spark, sf))


@query(f"SELECT method, pair_id AS size, list_sort(list(ms))[count(*) // 2 + 1] AS ms FROM {_RUNS_SQL} GROUP BY ALL")
def median_runs(spark, sf):
    return evaluate.median_times(_runs(spark, sf).withColumnRenamed("pair_id", "size"))


@query(f"SELECT count(*) AS runs, avg(precision) AS precision, avg(recall) AS recall FROM {_RUNS_SQL}")
def run_totals(spark, sf):
    return evaluate.totals(_runs(spark, sf))


@query(f"SELECT * FROM {_RUNS_SQL} ORDER BY seq DESC LIMIT 5")
def newest_runs(spark, sf):
    return evaluate.newest(_runs(spark, sf))


@query(f"WITH l AS (SELECT * FROM {_RUNS_SQL} QUALIFY row_number() OVER (PARTITION BY pair_id, method ORDER BY seq DESC) = 1) SELECT *, CAST(row_number() OVER (ORDER BY recall, precision, pair_id, method) AS INTEGER) AS place FROM l QUALIFY place <= 20")
def worst_recall(spark, sf):
    return evaluate.worst_first(_runs(spark, sf))


# --- sources and sinks --------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS src_rid, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ',\"a, \"\"b\"\"\",' || s_name ELSE s_name || ',plain,' || s_name END AS line FROM supplier")
def result_csv_shape(spark, sf):
    s = _read(spark, sf, "supplier")
    source = JoinTable.from_df(s.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, 'a, "b"').otherwise("plain").alias("note")), [], "s_suppkey")
    target = JoinTable.from_df(s.select("s_suppkey", "s_name"), [], "s_suppkey")
    pairs = s.select(F.col("s_suppkey").alias("src_rid"), F.col("s_suppkey").alias("tgt_rid"))
    lines = csv_lines(pairs, source, target)[1]
    # the supplier's number is in its name
    return lines.select(F.regexp_extract("line", r"#(\d+)", 1).cast("long").alias("src_rid"), "line")


@query("SELECT p_partkey AS _rid, trim(p_name) AS name, trim(p_brand) AS brand, '' AS pad FROM part")
def csv_scan(spark, sf):
    """Writes lines as the scan reads them: quoted commas, blank lines, short rows."""
    path = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    rows = _read(spark, sf, "part").select(F.array(F.concat(F.lit(' "'), F.col("p_partkey").cast("string"), F.lit('", '), F.col("p_name"), F.lit(" ,"), F.col("p_brand")), F.lit("  ")).alias("x"))
    head = spark.createDataFrame([(["key, name ,brand,pad", ""],)], "x array<string>")
    head.unionByName(rows).select(F.explode("x").alias("value")).coalesce(1).write.text(path)
    t = JoinTable.from_csv(spark, path, ["key"])
    return t.df.select(t.cell(0).cast("long").alias("_rid"), *[t.cell(t.position(n)).alias(n) for n in ("name", "brand", "pad")])


@query("SELECT p_name || ' | ' || p_brand || ' | ' || p_type AS record FROM part")
def bibliography(spark, sf):
    _, target = fixtures.bibliography(_read(spark, sf, "part"), ["p_name", "p_brand", "p_type"])
    return target.df.select(F.get("_cells", F.lit(0)).alias("record"))


@query("SELECT substring(c_name, 1, 1) || c_mktsegment AS target FROM customer")
def synthetic_userid(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("first"), F.col("c_mktsegment").alias("last"))
    return fixtures.synthetic(c, "userid", ["first", "last"])[1].df.select(F.get("_cells", F.lit(0)).alias("target"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS src_fp, max(n_name) AS tgt_fp FROM nation WHERE n_nationkey > 0 GROUP BY n_nationkey")
def ground_truth(spark, sf):
    """Later rows of a source replace earlier ones; rows with a blank side do not count."""
    n = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    early = n.select("k", F.col("k").alias("_rid"), F.array(F.col("k").cast("string"), F.lit("wrong")).alias("_cells"))
    late = n.select("k", (F.col("k") + 1000).alias("_rid"), F.array(F.col("k").cast("string"), F.col("n_name")).alias("_cells"))
    both = early.unionByName(late).where("k > 0").unionByName(late.where("k = 0").withColumn("_cells", F.array(F.lit("0"), F.lit(" "))))
    return fixtures.ground_truth(JoinTable(both.select("_rid", "_cells"), ["s", "t"]), 1)


def _synthetic(case: str, *columns: str) -> Query:
    """The target of a synthetic case over customers; its columns come from their names and numbers."""
    made = {"first": "c_mktsegment", "last": "c_name", "hour": "lpad(c_custkey % 24, 2, '0')", "minute": "lpad(c_custkey % 60, 2, '0')", "second": "lpad(c_custkey % 59, 2, '0')", "year": "cast(1980 + c_custkey % 40 as string)", "title": "c_mktsegment", "author1": "c_name"}

    def run(spark, sf):
        c = _read(spark, sf, "customer").selectExpr("c_custkey AS id", *[f"{made[n]} AS {n}" for n in columns])
        return fixtures.synthetic(c, case, list(columns))[1].df.select(F.get("_cells", F.lit(0)).alias("target"))

    return run


query("SELECT c_mktsegment || c_name AS target FROM customer", "synthetic_nameconcat")(_synthetic("nameconcat", "first", "last"))
query("SELECT lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 59 AS VARCHAR), 2, '0') AS target FROM customer", "synthetic_time")(_synthetic("time", "hour", "minute", "second"))
query("SELECT (1980 + c_custkey % 40) || ' ' || c_mktsegment || ' ' || c_name AS target FROM customer", "synthetic_citeseer")(_synthetic("citeseer", "year", "title", "author1"))


@query("SELECT c_custkey AS src_rid, CAST(c_custkey AS VARCHAR) AS tgt_fp FROM customer")
def table_keys(spark, sf):
    """The key of a table made from a DataFrame, as the joins see it."""
    t = JoinTable.from_df(_read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k")), ["k"], "c_custkey")
    return t.values(t.keys).select(F.col("_rid").alias("src_rid"), F.col("value").alias("tgt_fp"))
