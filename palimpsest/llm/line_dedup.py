"""Line deduplication by overlapping windows of three lines, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._util import fresh, salted_join


def _window_hashes(lines: Column, width: int) -> Column:
    """For each run of ``width`` lines: its place and a 128-bit hash; null where all of its lines are blank."""
    count = F.size(lines) - (width - 1)
    shifted = F.arrays_zip(F.sequence(F.lit(0), count - 1).alias("p"), *[F.slice(lines, i + 1, count).alias(f"l{i}") for i in range(width)])

    def hashed(x: Column) -> Column:
        run = [x[f"l{i}"] for i in range(width)]
        blank = F.lit(True)
        for line in run:
            blank = blank & (F.trim(line) == "")
        return F.when(~blank, F.struct(x["p"].alias("p"), F.xxhash64(*run).alias("a"), F.xxhash64(F.lit("second"), *run).alias("b")))

    return F.when(count > 0, F.filter(F.transform(shifted, hashed), lambda x: x.isNotNull()))


def repeated_windows(df: DataFrame, *, width: int, id_col: str, text_col: str) -> DataFrame:
    """(k, h, p): a text's id, its hash, and the place of each window of lines that occurs earlier.

    Occurrences are ordered by id, hash of the text and place; all but the first are returned.
    """
    lines = (
        df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("k"), F.xxhash64(F.col(text_col)).alias("h"), F.split(F.col(text_col), "\n", -1).alias("lines"))
        .where(F.size("lines") >= width)
    )
    windows = lines.select("k", "h", F.explode(_window_hashes(F.col("lines"), width)).alias("w")).select("k", "h", "w.p", "w.a", "w.b")
    # Counting comes before the shuffle, so that a window which a third of all texts share is a few rows there.
    firsts = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "h", "p")).alias("first")).where("n > 1")
    # Of the windows that many texts share, a bounded list is known beforehand; their rows are dealt over many tasks.
    repeated = salted_join(windows, firsts, ["a", "b"], "n", F.xxhash64("k", "h", "p"))
    return repeated.where(F.struct("k", "h", "p") != F.col("first")).select("k", "h", "p")


def covered_ranges(repeats: DataFrame, width: int) -> DataFrame:
    """(k, h, s, e): for each text the ascending starts and ends of the merged lines of its windows."""
    order = Window.partitionBy("k", "h").orderBy("p")
    merged = (
        repeats.distinct()
        .withColumn("new", F.when(F.col("p") - F.lag("p").over(order) <= width, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("k", "h", "island")
        .agg(F.min("p").alias("s"), (F.max("p") + width).alias("e"))
    )
    ranges = merged.groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    return ranges.select("k", "h", F.transform("r", lambda x: x["s"]).alias("s"), F.transform("r", lambda x: x["e"]).alias("e"))


def dedup_lines(df: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """Remove the lines of every later occurrence of a run of ``width`` lines.

    Texts are split at ``\\n``. A run is compared by a 128-bit hash, over all texts; its first
    occurrence, by id and then place, stays, and of the others the lines are removed, overlapping
    windows merged. In a text that repeats one line, later windows overlap the first, so that only
    its first line stays. Runs of blank lines alone are not compared.

    All columns are kept, and all rows: a text whose lines all go becomes empty. ``removed_col`` adds
    the number of lines removed, with ``_`` after its name if there is such a column. A null or empty text, one of fewer than ``width`` lines, and one
    with a null id, stays as it is. Rows of equal id and text count as one occurrence and are treated
    alike. No rows give no rows.
    """
    key, hashed, s, e, lines, cut = fresh([*df.columns, removed_col or ""], "k", "h", "s", "e", "lines", "cut")
    ranges = covered_ranges(repeated_windows(df, width=width, id_col=id_col, text_col=text_col), width)
    ranges = ranges.select(F.col("k").alias(key), F.col("h").alias(hashed), F.col("s").alias(s), F.col("e").alias(e))
    joined = df.join(ranges, (df[id_col] == ranges[key]) & (F.xxhash64(df[text_col]) == ranges[hashed]), "left")
    joined = joined.withColumn(lines, F.when(F.col(s).isNotNull(), F.split(F.col(text_col), "\n", -1)))
    kept = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col(e)).alias("a"),
        F.concat(F.col(s), F.array(F.size(lines))).alias("b"),
    )
    # The kept lines lie between the end of one range and the start of the next.
    rest = F.flatten(F.transform(kept, lambda x: F.slice(F.col(lines), x["a"] + 1, x["b"] - x["a"])))
    text = F.when(F.col(s).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text_col))
    gone = F.aggregate(F.zip_with(s, e, lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    out = [text.alias(c) if c == text_col else F.col(c) for c in df.columns]
    if removed_col:
        (removed_col,) = fresh(df.columns, removed_col)
        out.append(F.coalesce(gone, F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*out)
