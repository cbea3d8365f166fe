"""The search token table kept current by changes.

The table has one row per token of a document and one marker per document
(``pos`` 0, no token). A change writes the marker and the tokens of the
documents whose search form is new or different, and a marker alone for a
document that is gone. A document's rows are those of its latest change; which
that is follows from the markers, one row per changed document, so a search
still reads the rows of the asked tokens only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.operators.search import search_tokens

IS_MARKER = "pos = 0"


def with_markers(forms: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """``doc_id, pos, token``: a marker per document and the tokens of ``forms(doc_id, form)``."""
    markers = forms.select("doc_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("token"))
    tokens = search_tokens(forms, "doc_id", F.col("form")) if tokens is None else tokens
    return markers.unionByName(tokens)


def token_changes(before: DataFrame, after: DataFrame, whole: bool = False) -> DataFrame:
    """Rows to add when documents go from ``before`` to ``after`` (``doc_id, form`` each).

    Ids are unique. ``after`` may hold the touched documents only, and ``before``
    then needs no others either; with ``whole`` it holds all that are left, and
    documents missing from it are marked as gone. A null form has no tokens.
    """
    old = before.select("doc_id", F.col("form").alias("__old"), F.lit(True).alias("__known"))
    changed = (after.select("doc_id", "form").join(old, "doc_id", "left")
               .where(F.col("__known").isNull() | ~F.col("form").eqNullSafe(F.col("__old")))
               .select("doc_id", "form"))
    rows = with_markers(changed)
    if whole:
        gone = before.join(after.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        rows = rows.unionByName(gone.select("doc_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("token")))
    return rows


def current_tokens(base: DataFrame, *changes: DataFrame) -> DataFrame:
    """Token rows after all changes (written tables), in their order; markers are left out."""
    numbered = [c.withColumn("__v", F.lit(i)) for i, c in enumerate(changes)]
    tokens = base.where("token IS NOT NULL")
    if numbered:
        rows = numbered[0]
        for more in numbered[1:]:
            rows = rows.unionByName(more)
        last = rows.where(IS_MARKER).groupBy("doc_id").agg(F.max("__v").alias("__v"))
        tokens = (tokens.join(last.select("doc_id"), "doc_id", "left_anti").select("doc_id", "pos", "token")
                  .unionByName(rows.where("token IS NOT NULL").join(last, ["doc_id", "__v"], "left_semi")
                               .select("doc_id", "pos", "token")))
    return tokens
