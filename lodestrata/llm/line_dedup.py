"""Line dedup: drop lines that occur in more than ``most`` documents.

Lines (between line feeds) are normalised: lower case, runs of white space to one blank,
trimmed. A normalised line is known by two 64-bit hashes and its length. The documents are
exploded and normalised once, into a table of hashes and positions in the shared folder;
distinct documents are counted there, and the positions of lines to drop go back to their
documents, whose text is put together again from the other lines in their order, in time
proportional to its lines.

Blank lines are never dropped. A null text stays null, an empty one empty. A document is a
distinct doc_id (null is one); rows that repeat a doc_id count once for a line and are each
put together by themselves. A line in exactly ``most`` documents stays. Texts of any length
are taken whole, one in memory at a time. An empty table gives an empty result. Extra
columns are kept; one named ``n_dropped`` gives way to the count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestrata.llm import textkit as K
from lodestrata.runtime import cut, fresh, ship

MOST = 10


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\f\x0B]+", " "))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, g, n) of every line that isn't blank; th is a hash of the whole text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))  # below the explode, or the text is hashed for every line
    rows = rows.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", normal(F.col("line")).alias("line")).where("line <> ''")
    return rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(77), "line").alias("g"), F.length("line").alias("n"))


def frequent(rows: DataFrame, most: int) -> DataFrame:
    """(h, g, n) of the lines in more than ``most`` distinct documents."""
    once = rows.select("h", "g", "n", "doc_id").distinct()
    return once.groupBy("h", "g", "n").agg(F.count("*").alias("docs")).where(F.col("docs") > most).select("h", "g", "n")


def dedup_lines(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text``, and their number as ``n_dropped``."""
    ship(docs.sparkSession)
    rows = cut(lines(docs))
    gone = rows.join(frequent(rows, most), ["h", "g", "n"], "left_semi")
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    th, d, t, g = fresh(docs, "th", "d", "t", "g")
    gone = gone.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(g))
    out = docs.withColumn(th, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left")
    kept = [c for c in docs.columns if c.lower() != "n_dropped"]
    out = out.select(*[F.col(f"`{c}`") for c in kept], g)

    def put(batches):
        for b in batches:
            for part in K.slices(b):
                holes = part.column(g)
                at = [i for i, x in enumerate(holes.is_valid().to_pylist()) if x]
                n = [0] * part.num_rows
                i = part.schema.get_field_index("text")
                col = part.column(i)
                if at:
                    texts = col.to_pylist()
                    for r in at:
                        own = holes[r].as_py()
                        drop, own_lines = set(own), texts[r].split("\n")
                        n[r], texts[r] = len(own), "\n".join([x for k, x in enumerate(own_lines) if k not in drop])
                    col = pa.array(texts, part.schema.field(i).type)
                part = part.drop_columns([g])
                yield part.set_column(i, part.schema.field(i), col).append_column("n_dropped", pa.array(n, pa.int32()))

    return out.mapInArrow(put, StructType([*out.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, StructField("n_dropped", IntegerType(), False)]))
