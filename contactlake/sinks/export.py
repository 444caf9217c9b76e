"""Exports (S5-S8): CSV, JSON Lines, JSON array and TXT.

The text of a row is a column expression (``csv_line``, ``json_object``,
``txt_block``), so it can be checked as data; every writer range-sorts these
lines by ``ord`` and writes them as text.  Nothing is collected to the driver.
The part files, concatenated in name order, form the document: a header or a
bracket is a row of its own before or after the others.  ``single_file=True``
writes one part (the source's one-download behaviour; all rows pass one task,
so it is for results of a size that a download has).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.operators.reports import EXPORT_FIELDS, without_website
from contactlake.session import ensure_checkpoint_dir

# --- fixed values: export naming and the TXT layout -------------------------
BASE_NAME = "business-data"
NO_WEBSITE_NAME = "businesses-without-website"
TXT_RULE = "=" * 21
TXT_MISSING = "N/A"


def export_name(only_without_website: bool, fmt: str) -> str:
    """File name of an export."""
    return f"{NO_WEBSITE_NAME if only_without_website else BASE_NAME}.{fmt}"


def _chosen(fields) -> list[tuple[str, str]]:
    return [(k, lab) for k, lab in EXPORT_FIELDS if fields is None or k in fields]


def _prepare(df: DataFrame, fields, only_without_website: bool):
    """S8 guards + F1/F2: chosen (key, label) pairs and the filtered rows."""
    chosen = _chosen(fields)
    if not chosen:
        raise ValueError("export refused: no field selected")
    rows = without_website(df) if only_without_website else df
    if rows.isEmpty():
        raise ValueError("export refused: no row to export")
    return chosen, rows


def _layout(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def _write_lines(lines: DataFrame, path: str, single_file: bool, head: str | None = None, tail: str | None = None) -> None:
    """Write (ord, value) as lines in ``ord`` order, with a first and a last line."""
    spark = lines.sparkSession
    t = lines.select(F.lit(0).alias("__p"), F.col("ord").cast("long").alias("__o"), "value")
    edges = [(i, 0, v) for i, v in ((-1, head), (1, tail)) if v is not None]
    if edges:
        t = t.unionByName(spark.createDataFrame(edges, "__p int, __o long, value string"))
    out = t.orderBy("__p", "__o").select("value")
    _layout(out, single_file).write.mode("overwrite").option("lineSep", "\n").text(path)


def csv_field(c) -> F.Column:
    """Quoted only if it holds a quote, comma, CR or LF; quotes doubled; empty if missing."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(v.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(fields=None) -> F.Column:
    """One row of the chosen fields."""
    return F.concat_ws(",", *[csv_field(k) for k, _ in _chosen(fields)])


def csv_header(fields=None) -> str:
    return ",".join(lab for _, lab in _chosen(fields))


def _json_value(c) -> F.Column:
    """JSON text of one string value (Jackson escaping, as JSON.stringify)."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)


def json_object(fields=None) -> F.Column:
    """One object of a pretty-printed array (2-space indent)."""
    body = F.concat_ws(",\n", *[F.concat(F.lit(f'    "{k}": '), _json_value(k)) for k, _ in _chosen(fields)])
    return F.concat(F.lit("  {\n"), body, F.lit("\n  }"))


def txt_block(number, fields=None) -> F.Column:
    """``Business N:``, a rule of 21 ``=``, ``Label: value`` lines (``N/A``
    when empty) and a blank line."""
    n = F.col(number) if isinstance(number, str) else number
    lines = [F.concat(F.lit(f"{lab}: "), F.when(F.coalesce(F.col(k), F.lit("")) != "", F.col(k))
                      .otherwise(F.lit(TXT_MISSING))) for k, lab in _chosen(fields)]
    return F.concat_ws("\n", F.concat(F.lit("Business "), n.cast("string"), F.lit(":")), F.lit(TXT_RULE), *lines, F.lit(""))


def numbered(df: DataFrame, order: str = "ord", out: str = "number") -> DataFrame:
    """``df``, computed once, with consecutive numbers from 1 by ``order``: a range sort, rows
    counted per partition, and the partitions' offsets (a row per partition, so
    a broadcast of that size) joined back; no task sees all rows."""
    ensure_checkpoint_dir(df.sparkSession)
    # the sort samples its range bounds from the rows before it sorts them
    t = df.checkpoint(eager=True).orderBy(order).checkpoint(eager=True).withColumn("__m", F.monotonically_increasing_id())
    t = t.withColumn("__part", F.shiftright("__m", 33))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return t.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + place + 1).drop("__m", "__part", "__before")


def write_csv(df: DataFrame, path: str, fields=None, only_without_website: bool = False,
              single_file: bool = False) -> None:
    """One header of labels, then the rows."""
    _, rows = _prepare(df, fields, only_without_website)
    _write_lines(rows.select("ord", csv_line(fields).alias("value")), path, single_file, head=csv_header(fields))


def write_json_lines(df: DataFrame, path: str, fields=None, only_without_website: bool = False,
                     single_file: bool = False) -> None:
    """S6 as JSON Lines: one object per row with the chosen fields."""
    chosen, rows = _prepare(df, fields, only_without_website)
    out = rows.orderBy("ord").select(*[F.col(k) for k, _ in chosen])
    _layout(out, single_file).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, fields=None, only_without_website: bool = False,
                     single_file: bool = False) -> None:
    """S6 as one pretty-printed array; all objects but the last are followed by a comma."""
    _, rows = _prepare(df, fields, only_without_website)
    last = rows.agg(F.max("ord").alias("__last"))           # one row
    block = json_object(fields)
    objs = rows.join(F.broadcast(last), F.lit(True)).select("ord", F.when(
        F.col("ord") == F.col("__last"), block).otherwise(F.concat(block, F.lit(","))).alias("value"))
    _write_lines(objs, path, single_file, head="[", tail="]")


def write_txt(df: DataFrame, path: str, fields=None, only_without_website: bool = False,
              single_file: bool = False) -> None:
    """A block per row; N is 1-based in ``ord`` order."""
    _, rows = _prepare(df, fields, only_without_website)
    _write_lines(numbered(rows).select("ord", txt_block("number", fields).alias("value")), path, single_file)
