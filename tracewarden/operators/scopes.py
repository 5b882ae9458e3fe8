"""Which Python function a line belongs to, from indentation alone, as windows over the lines of a file.

A header opens its function; the next line that isn't blank and isn't indented deeper closes it. For each indentation that some header of a
file has, the lines that can open or close a function of that level are put in order, and every line that is asked about looks
back to the last of them: if it is a header, that function is open. The innermost open one is the deepest level's. So a line goes to
as many windows as its file has levels of headers, and a file's levels are worked apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^\s*(?:async\s+)?def\s+(\w+)\s*\("


def indented_lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text) of (file_path, content), lines from 1 with their indentation; tabs count as eight columns."""
    parts = F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")
    return files.select("file_path", parts).select("file_path", (F.col("pos") + 1).alias("line"), "text")


def enclosing_functions(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """(file_path, line, caller_func, caller_line): the innermost function around each line in ``sites`` (file_path, line); '' and 0 at module level.

    ``lines`` (file_path, line, text) keep their indentation. A header's own line belongs to the function around it. Blank lines and comment
    lines close nothing; lines within brackets or long strings count by their indentation like all others. Lines that ``lines``
    lacks, and repeated sites, give nothing and one row.
    """
    width = F.length(F.replace(F.regexp_extract("text", r"^([ \t]*)", 1), F.lit("\t"), F.lit(" " * 8)))
    known = lines.filter(r"text RLIKE '^[ \\t]*[^ \\t\\r\\n#]'").select("file_path", F.col("line").cast("long").alias("line"), width.alias("indent"), F.regexp_extract("text", HEADER, 1).alias("name"))
    asked = sites.select("file_path", F.col("line").cast("long").alias("line")).distinct().join(known.select("file_path", "line", "indent"), ["file_path", "line"]).withColumn("asks", F.lit(True))
    levels = known.filter("name <> ''").groupBy("file_path").agg(F.collect_set("indent").alias("levels"))
    # a line matters at the levels that it can close or open, a site at those that can hold it
    events = known.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("name", F.lit("")))
    met = events.join(levels, "file_path").withColumn("level", F.explode(F.filter("levels", lambda v: F.when(F.col("asks"), v < F.col("indent")).otherwise(v >= F.col("indent")))))
    above = Window.partitionBy("file_path", "level").orderBy("line", "asks").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(~F.col("asks"), F.struct(((F.col("name") != "") & (F.col("indent") == F.col("level"))).alias("opens"), "name", F.col("line").alias("at")))
    seen = met.withColumn("last", F.last(event, ignorenulls=True).over(above)).filter("asks AND last.opens")
    inner = seen.groupBy("file_path", "line").agg(F.max(F.struct("level", "last.name", "last.at")).alias("f"))
    found = asked.select("file_path", "line").join(inner, ["file_path", "line"], "left")
    return found.select("file_path", "line", F.coalesce("f.name", F.lit("")).alias("caller_func"), F.coalesce("f.at", F.lit(0)).cast("long").alias("caller_line"))
