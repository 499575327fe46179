"""Links from prose to many concepts: all terms are sought at once by one automaton, in time linear in the text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import markup as M

#: Terms of one automaton; it goes to every task. More terms are sought by several, one after the other.
MOST_TERMS = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_ALNUM = _WORD - {"_"}


def mentions(pages: DataFrame, page: str, prose: str, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(page, start, size, folded): where terms stand in a prose, overlapping ones too; ``folded`` is the term, A-Z lowered.

    Letters A-Z match in either case; a term with ASCII letters or digits stands alone. ``terms``: (term).
    """
    folded = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = terms.where("term <> ''").select(folded.alias("folded")).distinct()
    parts = max(1, -(-known.count() // most))
    found = None
    for i in range(parts):
        own = [r.folded for r in known.where(F.pmod(F.xxhash64("folded"), F.lit(parts)) == i).collect()]
        sought = pages.sparkSession.sparkContext.broadcast(own)

        def each(batches: Iterator[pa.RecordBatch], sought=sought) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in sought.value:
                automaton.add_word(term, (len(term), bool(_ALNUM & set(term))))
            if sought.value:
                automaton.make_automaton()
            for batch in batches:
                keys, starts, sizes, names = [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    low = (text or "").translate(_LOWER)
                    for end, (size, alone) in automaton.iter(low) if sought.value else ():
                        at = end + 1 - size
                        if not (alone and (at and low[at - 1] in _WORD or end + 1 < len(low) and low[end + 1] in _WORD)):
                            keys.append(k)
                            starts.append(at)
                            sizes.append(size)
                            names.append(low[at : end + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(names, pa.string())], [page, "start", "size", "folded"])

        kind = pages.schema[page].dataType.simpleString()
        part = pages.select(page, prose).mapInArrow(each, f"`{page}` {kind}, start int, size int, folded string")
        found = part if found is None else found.unionByName(part)
    return found


def linked(pages: DataFrame, page: str, body: str, terms: DataFrame, suppressed: str | None = None, most: int = MOST_TERMS) -> DataFrame:
    """``pages`` with the first mention of each concept in ``body`` as a link, as ``markup.concept_links`` makes them.

    ``terms``: (term, canonical, href, title, summary), any number of them. ``page`` tells pages apart.
    """
    prose = M.masked(F.col(body), f"{M.FENCE}|{M.PROSE_GUARD}")
    given = pages.select(page, F.when(F.col(body).isNotNull(), prose).alias("prose"))
    names = terms.withColumn("folded", F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    met = mentions(given, page, "prose", terms, most).join(names, "folded")
    # A term without letters A-Z is what it is; others match in either case, which the automaton has seen to.
    mention = F.struct("start", (-F.col("size")).alias("order"), "canonical", F.struct("href", "title", "summary").alias("of"))
    gathered = met.groupBy(page).agg(F.collect_list(mention).alias("folio_found"))
    none = F.array().cast("array<string>")
    joined = pages.join(gathered, page, "left")
    made = M.linked_at(F.col(body), F.col("folio_found"), F.col(suppressed) if suppressed else none)
    return joined.withColumn(body, F.when(F.col("folio_found").isNull(), F.col(body)).otherwise(made)).drop("folio_found")
