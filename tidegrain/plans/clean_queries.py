"""Queries on raw values, row rules and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.operators import checks, clean

from .inputs import calendar, raw_sales, sales, table
from .registry import part, query

MARKS = "".join(T.MARKED.values())
PLAIN = "".join(k * len(v) for k, v in T.MARKED.items())
IMPORT_CASE = "CASE " + " ".join(f"WHEN {{c}} IN ({', '.join(repr(a) for a in v)}) THEN '{k}'" for k, v in T.IMPORT_UNITS.items()) + " ELSE {c} END"
PLAN_CASE = "CASE " + " ".join(f"WHEN {{c}} IN ({', '.join(repr(a) for a in v)}) THEN '{k}'" for k, v in T.PLANNING_UNITS.items()) + " ELSE {c} END"

part(
    "adapted",
    f"""SELECT row_id, try_cast(date_text AS DATE) AS date, coalesce(nullif(trim(store_text), ''), 'ALL') AS store_key,
  CASE WHEN trim(product_text) <> '' THEN 'PRODUCT_' || substr(sha1(regexp_replace(regexp_replace(translate(lower(trim(product_text)), '{MARKS}', '{PLAIN}'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')), 1, 12) END AS product_key,
  CASE WHEN quantity_text = '1,234' THEN NULL ELSE try_cast(replace(quantity_text, ',', '.') AS DOUBLE) END AS quantity_sold, revenue,
  CASE stockout_text WHEN 'có' THEN true WHEN 'no' THEN false END AS is_stockout, {IMPORT_CASE.format(c='lower(trim(unit_text))')} AS unit FROM @raw_sales""",
)
part("valid", "SELECT * FROM @adapted WHERE date IS NOT NULL AND product_key IS NOT NULL AND quantity_sold >= 0")


def adapted(spark, sf):
    return clean.adapt_sales(raw_sales(spark, sf))


def judged(spark, sf):
    """What the fatal rules read, and no more."""
    return clean.adapt_sales(raw_sales(spark, sf), columns=("date", "product_key", "quantity_sold"), hashed=False)


@query(
    "clean_sales",
    "valid",
    """SELECT date, store_key, product_key, round(sum(quantity_sold), 6) AS quantity_sold, round(sum(revenue), 4) AS revenue, bool_or(is_stockout) AS is_stockout, arg_min(unit, row_id) AS unit, count(*) AS n_rows FROM valid GROUP BY 1, 2, 3""",
)
def clean_sales(spark, sf):
    d = clean.daily(clean.valid_sales(adapted(spark, sf)), ["date", "store_key", "product_key"])
    return d.withColumn("quantity_sold", F.round("quantity_sold", 6)).withColumn("revenue", F.round("revenue", 4))


@query("null_reason_counts", "adapted", "SELECT count(*) FILTER (date IS NULL) AS null_date, count(*) FILTER (product_key IS NULL) AS null_product, count(*) FILTER (quantity_sold IS NULL) AS null_quantity, count(*) FILTER (quantity_sold < 0) AS negative_quantity FROM adapted")
def null_reason_counts(spark, sf):
    return checks.counts_of(judged(spark, sf), clean.fatal_rules())


part(
    "number_texts",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '1.' || lpad((event_id % 900)::VARCHAR, 3, '0') || ',' || (event_id % 90 + 10) WHEN 1 THEN '2,' || lpad((event_id % 900)::VARCHAR, 3, '0') || '.5' WHEN 2 THEN (event_id % 500) || ',25'
  WHEN 3 THEN '1,234' WHEN 4 THEN '1.2.3' WHEN 5 THEN 'n/a' ELSE ' ' || (event_id % 100) || '.5 ' END AS raw FROM events""",
)


def number_texts(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    n = lambda m: (F.col("event_id") % m).cast("string")
    k = F.col("event_id") % 7
    return e.withColumn(
        "raw",
        F.when(k == 0, F.concat(F.lit("1."), F.lpad(n(900), 3, "0"), F.lit(","), (F.col("event_id") % 90 + 10).cast("string"))).when(k == 1, F.concat(F.lit("2,"), F.lpad(n(900), 3, "0"), F.lit(".5")))
        .when(k == 2, F.concat(n(500), F.lit(",25"))).when(k == 3, "1,234").when(k == 4, "1.2.3").when(k == 5, "n/a").otherwise(F.concat(F.lit(" "), n(100), F.lit(".5 "))),
    )


@query(
    "parse_number_locale",
    "number_texts",
    """SELECT event_id, raw, CASE event_id % 7 WHEN 0 THEN replace(replace(raw, '.', ''), ',', '.')::DOUBLE WHEN 1 THEN replace(raw, ',', '')::DOUBLE WHEN 2 THEN replace(raw, ',', '.')::DOUBLE WHEN 6 THEN trim(raw)::DOUBLE END AS number,
  CASE event_id % 7 WHEN 3 THEN 'NUMBER_SEPARATOR_AMBIGUOUS' WHEN 4 THEN 'NUMBER_SEPARATOR_AMBIGUOUS' WHEN 5 THEN 'NUMBER_INVALID' END AS issue FROM number_texts""",
)
def parse_number_locale(spark, sf):
    return number_texts(spark, sf).select("event_id", "raw", T.parse_number(F.col("raw")).alias("number"), T.number_issue(F.col("raw")).alias("issue"))


@query(
    "parse_date_locale",
    "",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE ELSE CASE WHEN day(o_orderdate) > 12 THEN o_orderdate::DATE END END AS date,
  CASE WHEN o_orderkey % 3 = 2 AND day(o_orderdate) <= 12 THEN 'DATE_LOCALE_AMBIGUOUS' END AS issue FROM orders""",
)
def parse_date_locale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("d", "yyyy/M/d")).otherwise(F.date_format("d", "d/M/yyyy"))
    o = o.withColumn("raw", raw)
    date = F.when(k == 1, T.parse_date(F.col("raw"), "DMY")).otherwise(T.parse_date(F.col("raw")))
    issue = F.when(k == 1, T.date_issue(F.col("raw"), "DMY")).otherwise(T.date_issue(F.col("raw")))
    return o.select("o_orderkey", date.alias("date"), issue.alias("issue"))


KEY_SQL = f"regexp_replace(regexp_replace(translate(lower(trim(coalesce({{c}}, ''))), '{MARKS}', '{PLAIN}'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"


@query("text_key", "", f"SELECT doc_id, {KEY_SQL.format(c='text')} AS key, 'DOC_' || substr(sha1({KEY_SQL.format(c='text')}), 1, 12) AS id FROM documents")
def text_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_key(F.col("text")).alias("key"), T.stable_id("DOC", F.col("text")).alias("id"))


@query("unit_alias", "raw_sales", f"SELECT unit_text, {IMPORT_CASE.format(c='lower(trim(unit_text))')} AS import_unit, {PLAN_CASE.format(c='lower(trim(unit_text))')} AS planning_unit, count(*) AS n FROM raw_sales GROUP BY 1")
def unit_alias(spark, sf):
    return raw_sales(spark, sf).groupBy("unit_text").agg(F.count("*").alias("n")).select("unit_text", T.normalize_unit(F.col("unit_text"), T.IMPORT_UNITS).alias("import_unit"), T.normalize_unit(F.col("unit_text")).alias("planning_unit"), "n")


@query("flatten_json_props", "", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS \"props.k\" FROM events")
def flatten_json_props(spark, sf):
    from tidegrain.sources.files import flatten

    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return flatten(e)


@query("total_row_filter", "", "SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN ' Total ' WHEN 1 THEN 'SUBTOTAL' ELSE event_type END AS kind FROM events) WHERE lower(trim(kind)) NOT IN ('total', 'subtotal') GROUP BY 1")
def total_row_filter(spark, sf):
    k = F.col("event_id") % 4
    e = table(spark, sf, "events").withColumn("kind", F.when(k == 0, " Total ").when(k == 1, "SUBTOTAL").otherwise(F.col("event_type")))
    return clean.drop_totals(e, "kind").groupBy("kind").agg(F.count("*").alias("n"))


@query("repeated_headers", "", "SELECT user_id, count(*) AS n FROM events WHERE NOT (event_id % 50 = 0) GROUP BY 1")
def repeated_headers(spark, sf):
    cells = ["event_type", "value", "props"]
    broken = F.col("event_id") % 50 == 0
    e = table(spark, sf, "events").select("user_id", *[F.when(broken, F.lit(c.upper())).otherwise(F.col(c).cast("string")).alias(c) for c in cells])
    return e.where(~clean.repeats_header(cells)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "quarantine_split",
    "raw_sales adapted",
    """SELECT issue, count(*) AS n, min(row_id) AS first_row FROM (SELECT row_id, unnest(list_filter([CASE WHEN date IS NULL THEN 'null_date' END, CASE WHEN product_key IS NULL THEN 'null_product' END,
  CASE WHEN quantity_sold IS NULL THEN 'null_quantity' END, CASE WHEN quantity_sold < 0 THEN 'negative_quantity' END], lambda x: x IS NOT NULL)) AS issue FROM adapted) GROUP BY 1""",
)
def quarantine_split(spark, sf):
    _, away = clean.quarantine(judged(spark, sf), clean.fatal_rules())
    return away.select("row_id", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query(
    "row_lineage",
    "adapted",
    "SELECT row_id, 'raw_sales' AS container, array_to_string(list_filter(['date_text', CASE WHEN product_key IS NOT NULL THEN 'product_text' END, CASE WHEN quantity_sold IS NOT NULL THEN 'quantity_text' END], lambda x: x IS NOT NULL), ',') AS used FROM adapted WHERE date IS NOT NULL",
)
def row_lineage(spark, sf):
    used = F.filter(F.array(F.lit("date_text"), F.when(F.col("product_key").isNotNull(), F.lit("product_text")), F.when(F.col("quantity_sold").isNotNull(), F.lit("quantity_text"))), lambda x: x.isNotNull())
    return judged(spark, sf).where("date IS NOT NULL").select("row_id", F.lit("raw_sales").alias("container"), F.array_join(used, ",").alias("used"))


@query(
    "column_profile",
    "adapted",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS greatest FROM adapted" for c in ("store_key", "product_key", "unit", "is_stockout", "date")),
)
def column_profile(spark, sf):
    return clean.profile(adapted(spark, sf), ["store_key", "product_key", "unit", "is_stockout", "date"])


@query("table_quality", "adapted", "SELECT count(*) AS n_rows, count(*) FILTER (k > 1) AS n_duplicate_rows, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, count(*) OVER (PARTITION BY date, store_key, product_key) AS k FROM adapted)")
def table_quality(spark, sf):
    return clean.table_quality(adapted(spark, sf), ["date", "store_key", "product_key"], "date")


@query(
    "readiness",
    "adapted",
    """SELECT capability, CASE WHEN max(s) = 2 THEN 'blocked' WHEN max(s) = 1 THEN 'degraded' ELSE 'ready' END AS status, count(*) FILTER (s = 2) AS n_errors FROM (
  SELECT 'forecast' AS capability, CASE WHEN quantity_sold IS NULL THEN 2 ELSE 0 END AS s FROM adapted UNION ALL SELECT 'pricing', CASE WHEN unit = 'each' THEN 1 ELSE 0 END FROM adapted UNION ALL SELECT 'stores', 0 FROM adapted) GROUP BY 1""",
)
def readiness(spark, sf):
    a = adapted(spark, sf)
    each = F.array(
        F.struct(F.lit("forecast").alias("capability"), F.when(F.col("quantity_sold").isNull(), "error").otherwise("none").alias("severity")),
        F.struct(F.lit("pricing").alias("capability"), F.when(F.col("unit") == "each", "warning").otherwise("none").alias("severity")),
        F.struct(F.lit("stores").alias("capability"), F.lit("none").alias("severity")),
    )
    return clean.readiness(a.select(F.inline(each)))


@query("entity_conflicts", "", "SELECT entity, ids FROM (SELECT p_name AS entity, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS ids, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) WHERE n > 1")
def entity_conflicts(spark, sf):
    return clean.conflicting_entities(table(spark, sf, "part"), "p_name", "p_brand")


_H = "sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority))"


@query(
    "fingerprint",
    "",
    f"SELECT count(*) AS n_rows, sha256(concat_ws('|', count(*)::VARCHAR, {', '.join(f'sum((0x0 || substr(h, {1 + 8 * k}, 8))::BIGINT)::VARCHAR' for k in range(4)).replace('(0x0 ||', chr(40) + repr('0x') + ' ||')})) AS fingerprint FROM (SELECT {_H} AS h FROM orders)",
)
def fingerprint(spark, sf):
    return clean.fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("parse_boolean", "", "SELECT word, CASE WHEN lower(trim(word)) IN ('1', 'true', 'yes', 'y', 'co', 'có', 'x') THEN true WHEN lower(trim(word)) IN ('0', 'false', 'no', 'n', 'khong', 'không') THEN false END AS truth, count(*) AS n FROM (SELECT ['Yes', ' no ', 'CÓ', 'Không', 'maybe', '1', '0', ''][event_id % 8 + 1] AS word FROM events) GROUP BY ALL")
def parse_boolean(spark, sf):
    words = F.array(*[F.lit(w) for w in ("Yes", " no ", "CÓ", "Không", "maybe", "1", "0", "")])
    e = table(spark, sf, "events").select(F.element_at(words, (F.col("event_id") % 8 + 1).cast("int")).alias("word"))
    return e.groupBy("word", T.parse_boolean(F.col("word")).alias("truth")).agg(F.count("*").alias("n"))


@query("clean_calendar", "calendar", "SELECT date, bool_or(is_holiday) AS is_holiday, avg(temperature) AS temperature, count(*) AS n_rows FROM (SELECT CASE WHEN day(date) = 31 THEN NULL ELSE date END AS date, is_holiday, temperature FROM calendar UNION ALL SELECT date, true, temperature + 2 FROM calendar WHERE day(date) = 5) WHERE date IS NOT NULL GROUP BY 1")
def clean_calendar(spark, sf):
    c = calendar(spark, sf)
    rows = c.select(F.when(F.dayofmonth("date") != 31, F.col("date")).alias("date"), "is_holiday", "temperature")
    again = c.where(F.dayofmonth("date") == 5).select("date", F.lit(True).alias("is_holiday"), (F.col("temperature") + 2).alias("temperature"))
    return rows.unionByName(again).where("date IS NOT NULL").groupBy("date").agg(F.bool_or("is_holiday").alias("is_holiday"), F.avg("temperature").alias("temperature"), F.count("*").alias("n_rows"))


@query("row_contracts", "", "SELECT failed, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c_mktsegment = '' THEN 'EMPTY_KEY' END, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_acctbal > 9000 THEN 'TOO_LARGE' END) AS failed FROM customer) GROUP BY 1")
def row_contracts(spark, sf):
    rules = {"EMPTY_KEY": F.col("c_mktsegment") == "", "NEGATIVE": F.col("c_acctbal") < 0, "TOO_LARGE": F.col("c_acctbal") > 9000}
    return table(spark, sf, "customer").groupBy(F.array_join(checks.failed(rules), ",").alias("failed")).agg(F.count("*").alias("n"))


@query("column_operations", "raw_sales", f"SELECT row_id, trim(store_text) AS store, n_name AS nation, l.quantity * CASE WHEN u = 'g' THEN 0.001::DOUBLE ELSE 1 END AS quantity, CASE WHEN u = 'g' THEN 'kg' ELSE u END AS unit FROM (SELECT *, try_cast(replace(CASE WHEN quantity_text = '1,234' THEN NULL ELSE quantity_text END, ',', '.') AS DOUBLE) AS quantity, row_id % 25 AS nk, CASE lower(trim(unit_text)) WHEN 'grams' THEN 'g' ELSE lower(trim(unit_text)) END AS u FROM raw_sales) l JOIN nation ON nk = n_nationkey")
def column_operations(spark, sf):
    from tidegrain.operators.columns import apply_operations

    codes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("meaning"))
    unit = F.lower(F.trim("unit_text"))
    rows = raw_sales(spark, sf).select("row_id", F.col("store_text").alias("store"), (F.col("row_id") % 25).alias("nation"), F.col("quantity_text").alias("quantity"), F.when(unit == "grams", "g").otherwise(unit).alias("unit"))
    steps = [("trim", "store"), ("parse_number", "quantity"), ("lookup", "nation", codes), ("convert", "quantity", "unit", "g", "kg", 0.001)]
    return apply_operations(rows, steps)


@query("point_in_time", "sales", "SELECT store_key, count(*) AS n, max(date) AS latest FROM sales WHERE date <= DATE '1997-06-30' GROUP BY 1")
def point_in_time(spark, sf):
    return sales(spark, sf).where(F.col("date") <= F.lit("1997-06-30").cast("date")).groupBy("store_key").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


@query("conflict_examples", "adapted", "SELECT * EXCLUDE k FROM (SELECT store_key, row_id, unit, row_number() OVER (PARTITION BY store_key ORDER BY row_id) AS k FROM adapted WHERE date IS NULL) WHERE k <= 5")
def conflict_examples(spark, sf):
    from tidegrain.operators.ranking import first_rows

    return first_rows(adapted(spark, sf).where("date IS NULL"), ["store_key"], ["row_id"], 5).select("store_key", "row_id", "unit")
