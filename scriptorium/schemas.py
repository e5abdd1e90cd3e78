"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TEXTS, VECTOR = T.ArrayType(TEXT), T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENTRY = _struct(doc_id=TEXT, path=TEXT, rev=TEXT, children=TEXTS, mtime=LONG)
LISTING = _struct(
    id=TEXT, key=TEXT, value=_struct(rev=TEXT), doc=_struct(_id=TEXT, type=TEXT, path=TEXT, deleted=FLAG, children=TEXTS, mtime=LONG, data=TEXT)
)
NOTE = _struct(doc_id=TEXT, path=TEXT, rev=TEXT, mtime=LONG, markdown=TEXT)
CHANGE = _struct(doc_id=TEXT, path=TEXT, rev=TEXT, mtime=LONG, markdown=TEXT, deleted=FLAG)
DOCS = _struct(doc_id=TEXT, path=TEXT, title=TEXT, rev=TEXT, content_hash=TEXT, sensitivity=TEXT, mtime=LONG, frontmatter=TEXT)
CHUNKS = _struct(chunk_id=TEXT, doc_id=TEXT, ordinal=INT, heading_path=TEXT, prelude=TEXT, body=TEXT, sensitivity=TEXT)
VECTORS = _struct(chunk_id=TEXT, embedding=VECTOR)
POSTINGS = _struct(term=TEXT, block=LONG, chunk_id=TEXT, tf=LONG, dl=LONG)
#: Of each block of postings: how many, the largest tf, the least dl. Rows with a chunk_id take back what that chunk, since replaced, had counted.
BLOCKS = _struct(term=TEXT, block=LONG, n=LONG, most_tf=LONG, least_dl=LONG, chunk_id=TEXT)
LENGTHS = _struct(chunk_id=TEXT, dl=LONG)
EDGES = _struct(src=TEXT, dst=TEXT, kind=TEXT, resolved=FLAG)
#: Notes that were deleted, and when: an older revision that comes later does not bring them back.
GONE = _struct(doc_id=TEXT, mtime=LONG, rev=TEXT)
META = _struct(key=TEXT, value=TEXT)
QUESTIONS = _struct(qid=LONG, text=TEXT)
MESSAGES = _struct(conv_id=LONG, turn=LONG, role=TEXT, content=TEXT)

SENSITIVITIES = ("open", "personal")
KINDS = ("wikilink", "topic", "tag")
