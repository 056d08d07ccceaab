"""Documents cut into chunks with character and page positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

WINDOW, OVERLAP = 5, 1
HEADING_CHARS = 80
PAGE_BREAK = "\f"


def is_heading(line: Column) -> Column:
    """Short line that is marked, numbered, or written in capitals."""
    text = F.trim(line)
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    marked = text.rlike(r"^(#{1,6} |([0-9]+\.)+ )")
    return (F.length(text) >= 3) & (F.length(text) <= HEADING_CHARS) & (marked | capitals)


def _spans(lines: list[dict], window: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(chunk index, first line, line behind the last) of a document. A paragraph is a line that is not
    blank together with the blank lines behind it; a section starts at a heading."""
    if any(x["heading"] for x in lines):
        start, section = 0, int(lines[0]["heading"])
        for i, x in enumerate(lines[1:], 1):
            if x["heading"]:
                yield section, start, i
                start, section = i, section + 1
        yield section, start, len(lines)
        return
    starts = [i for i, x in enumerate(lines) if x["filled"]]
    begins = [0, *starts[1:]]  # blank lines at the top belong to the first paragraph
    last = max(-(-(len(begins) - (window - step)) // step) - 1, 0)
    for n in range(last + 1):
        end = n * step + window
        yield n, begins[n * step], begins[end] if end < len(begins) else len(lines)


def chunk_documents(
    docs: DataFrame, key: str, keep: list[str] | None = None, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP
) -> DataFrame:
    """Sections where a document has headings, else windows of paragraphs with overlap.

    A document is cut within its row: the expressions mark its lines, one pass inside the task adds up
    positions, and nothing is shuffled. Every chunk is an exact stretch of its document.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be smaller than the window")
    keep = keep or []
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(PAGE_BREAK), F.lit("")))
    facts = F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            F.length(x).alias("length"), breaks(x).alias("breaks"), (F.trim(x) != "").alias("filled"), is_heading(x).alias("heading")
        ),
    )
    rows = docs.where(F.col(text).isNotNull()).select(key, *keep, F.col(text).alias("_text"), facts.alias("_lines"))
    kept = [key, *keep]
    chunk = {"chunk_index": pa.int64(), "chunk_rule": pa.string(), "start_char": pa.int64(), "end_char": pa.int64(), "page_start": pa.int64(), "page_end": pa.int64(), "chunk_text": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body, lines in zip(batch.column("_text").to_pylist(), batch.column("_lines").to_pylist()):
                at, page, starts, pages = 0, 1, [], []
                for x in lines:
                    starts.append(at)
                    pages.append(page)
                    at, page = at + x["length"] + 1, page + x["breaks"]
                rule = "heading" if any(x["heading"] for x in lines) else "window"
                mine = []
                for n, a, b in _spans(lines, window, window - overlap):
                    end = starts[b - 1] + lines[b - 1]["length"]
                    values = (n, rule, starts[a], end, pages[a], pages[b - 1], body[starts[a] : end])
                    mine.append(dict(zip(chunk, values)))
                found.append(mine)
            column = pa.array(found, pa.list_(pa.struct(chunk)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, "_chunks"])

    kind = {"chunk_rule": StringType(), "chunk_text": StringType()}
    fields = StructType([StructField(n, kind.get(n, LongType())) for n in chunk])
    schema = StructType([*(rows.schema[c] for c in kept), StructField("_chunks", ArrayType(fields))])
    return rows.mapInArrow(cut, schema).select(*kept, F.explode("_chunks").alias("_c")).select(*kept, "_c.*")
