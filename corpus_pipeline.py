"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to source weights, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from brindle.llm.exact_dedup import drop_copies
from brindle.llm.langid import filter_languages
from brindle.llm.mixing import mixed_documents
from brindle.llm.packing import pack_documents
from brindle.llm.simhash import drop_near_copies
from brindle.llm.work import Workspace, table


def language(spark, docs, sf_dir):
    """Documents whose language can be told; those without letters or unlike any language go."""
    return filter_languages(docs)


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark, docs, sf_dir):
    """One document of each component of near copies."""
    return drop_near_copies(docs)


def mix(spark, docs, sf_dir):
    """Stretches of the documents, as often as the mix takes them: each source near its target."""
    return mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """The pieces of all documents, with their sequences and offsets."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Language vectors and packing are not SQL; tests hold each stage against brute force, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages, one after the other, over all documents; each result is a table in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
