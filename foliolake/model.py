"""Schemas of the tables that the engine reads and writes.

Sections, tables, key figures and answers are ordinary DataFrames keyed by
``doc_id``; cells of source tables stay strings and are typed when queried.
"""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


TABLE = _struct(("table_id", _S), ("caption", _S), ("headers", T.ArrayType(_S)), ("rows", T.ArrayType(T.ArrayType(_S))))
IMAGE = _struct(("image_id", _S), ("alt", _S), ("asset_path", _S))
META = _struct(("owner", _S), ("department", _S), ("tags", T.ArrayType(_S)), ("access_roles", T.ArrayType(_S)), ("version", _S), ("last_updated", _S))

#: What a source yields: sections in reading order, before numbering.
RAW_SECTIONS = _struct(("doc_id", _S), ("doc_title", _S), ("source", _S), ("format", _S), ("sec_idx", _I), ("title", _S), ("level", _I), ("text", _S), ("tables", T.ArrayType(TABLE)), ("images", T.ArrayType(IMAGE)), ("error", _S))
#: Sections with numbers, parents, derived counts, keywords and summaries.
SECTIONS = _struct(("doc_id", _S), ("sec_idx", _I), ("id", _S), ("title", _S), ("level", _I), ("text", _S), ("tables", T.ArrayType(TABLE)), ("images", T.ArrayType(IMAGE)), ("parent_id", _S), ("children", T.ArrayType(_S)), ("token_count", _I), ("summary", _S), ("keywords", T.ArrayType(_S)), ("embedding", T.ArrayType(T.FloatType())))
DOCUMENTS = _struct(("doc_id", _S), ("title", _S), ("source", _S), ("format", _S), ("summary", _S), ("insights", T.ArrayType(_S)), ("meta", META))
KEY_NUMBERS = _struct(("doc_id", _S), ("ord", _I), ("label", _S), ("value", _S), ("unit", _S), ("section", _S))
EDGES = _struct(("doc_id", _S), ("from_idx", _I), ("to_idx", _I), ("edge_type", _S), ("weight", _D))
LIBRARY = _struct(("doc_id", _S), ("title", _S), ("path", _S), ("source_format", _S), ("owner", _S), ("department", _S), ("tags", T.ArrayType(_S)), ("access_roles", T.ArrayType(_S)), ("version", _S), ("last_updated", _S), ("summary", _S), ("section_count", _I), ("added_at", _S), ("keywords", T.ArrayType(_S)))
ANSWERS = _struct(("qid", _S), ("doc_id", _S), ("answer", _S), ("citations", T.ArrayType(_S)), ("navigate_to", _S), ("layer_used", _I), ("tokens_used", _I), ("confidence", _D))
REGISTRY = _struct(("doc_id", _S), ("hash", _S), ("n_secs", _I), ("built_at", _D))
