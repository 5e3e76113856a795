"""Schemas of the tables that pipelines pass on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_LIST = T.ArrayType(T.StringType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: One publication. rec_id is its place in the input; missing values are null, an unknown year too.
RECORDS = _table(rec_id=_L, title=_S, abstract=_S, source=_S, doi=_S, volume=_S, pages=_S, doc_type=_S, publisher=_S, language=_S, key=_S, year=T.IntegerType(), cites=T.IntegerType(), authors=_LIST, keywords=_LIST, index_terms=_LIST, affiliations=_LIST, countries=_LIST, refs=_LIST)
#: One unit of one document: pos is its place there.
INCIDENCE = _table(doc=_L, key=_S, label=_S, pos=T.IntegerType())
NODES = _table(key=_S, label=_S, links=_L, total_link_strength=_D, occurrences=_L, citations=_L, avg_year=_D, avg_citations=_D, norm_citations=_D)
LINKS = _table(a=_S, b=_S, w=_D, s=_D)
THESAURUS = _table(key=_S, replace_by=_S)
