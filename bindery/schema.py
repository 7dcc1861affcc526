"""The tables of the engine and their types."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, TS, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BinaryType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENTS = struct(doc_id=S, user_id=S, original_name=S, format=S, content=B)
SEGMENTS = struct(doc_id=S, ord=I, title=S, body=S)
ASSETS = struct(doc_id=S, ord=I, src=S, content=B)
BUNDLE_FILES = struct(job_id=S, path=S, content=S)
JOBS = struct(id=S, user_id=S, original_name=S, format=S, object_key=S, status=S, error_message=S, retry_of=S, attempt=I, created_at=TS, updated_at=TS)
JOB_EVENTS = struct(job_id=S, seq=L, ts=TS, event=S, error_message=S)
JOB_MESSAGES = struct(job_id=S, user_id=S, format=S, object_key=S, attempt=I)
BUNDLES = struct(id=S, job_id=S, path=S, validation=S, warnings=T.ArrayType(S), created_at=TS)
PDF_RUNS = struct(doc_id=S, page=I, ord=I, top=D, left=D, width=D, size=D, text=S)
PDF_IMAGES = struct(doc_id=S, page=I, ord=I, page_w=D, page_h=D, top=D, left=D, width=D, height=D, src=S)
BOOKMARKS = struct(doc_id=S, ord=I, depth=I, title=S, page=I)

#: Formats, states and validation levels.
FORMATS = ("md", "txt", "html", "pdf", "docx", "epub")
FORMAT_ALIASES = {"md": "md", "markdown": "md", "txt": "txt", "text": "txt", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "epub": "epub"}
STATES = ("pending", "processing", "completed", "failed", "canceled")
LEVELS = ("valid", "valid_with_warnings", "invalid")
MAX_UPLOAD = 100 * 1024 * 1024
#: Bytes that the parts of one document may have when they are inflated.
MAX_INFLATED = 4 * MAX_UPLOAD
#: Seconds that the reading of one document may take.
DOCUMENT_SECONDS = 1800.0
