"""Lines of documents, blocks of transcripts, cues; and removal of repeated lines."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clock, text_key
from lectern.operators.positions import numbered

STAMP = r"[0-9]{2,}:[0-9]{2}:[0-9]{2}\.[0-9]{3}"


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line) of each document's text; null texts have none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def first_lines(lines: DataFrame) -> DataFrame:
    """Each key's first line in its document; lines without letters and digits are left out."""
    keyed = lines.select("doc_id", "line_no", text_key(F.col("line")).alias("key")).where("key <> ''")
    return keyed.groupBy("doc_id", "key").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))


def transcript_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, start, end, label, body): blocks of ``[start -> end] label`` and the lines up to an empty one."""
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("block", "raw"))
    head = rf"^\[({STAMP}) -> ({STAMP})\] ([^\n]*)\n"
    got = [F.regexp_extract("raw", head, k) for k in (1, 2, 3)]
    return blocks.where(F.col("raw").rlike(head)).select("doc_id", "block", got[0].alias("start"), got[1].alias("end"), got[2].alias("label"), F.regexp_replace("raw", head, "").alias("body"))


def srt_cues(speech: DataFrame, width: int = 900_000) -> DataFrame:
    """(job_id, cue_no, cue): numbered subtitle cues in order of time."""
    rows = numbered(speech, ["job_id"], ["start_ms", "speech_id"], width, "cue_no")
    times = F.concat(clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","))
    return rows.select("job_id", "cue_no", F.concat_ws("\n", F.col("cue_no").cast("string"), times, F.concat(F.col("speaker"), F.lit(": "), F.coalesce("text", F.lit("")))).alias("cue"))


#: Bins of the character counts that bound how much two lines can share.
BINS = 64


def kept_lines(keys: list[str], ratio: float = 0.9, least: int = 6) -> list[int]:
    """Positions of the keys that stay, in order: repeats are left out, exact or, of at least ``least`` characters, at
    ``ratio`` or more to one that stayed. Empty keys are left out.

    Two lines share at most as many characters as their counts in bins do; this
    bound is worked out for all kept lines at once, and only those that pass it are compared.
    """
    out, seen = [], set()
    counts, sizes, kept = np.zeros((64, BINS), np.int32), np.zeros(64, np.int64), []
    for no, key in enumerate(keys):
        if not key or key in seen:
            continue
        if len(key) >= least:
            own = np.bincount(np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS)
            n = len(kept)
            most = 2 * np.minimum(counts[:n], own).sum(1)
            if any(difflib.SequenceMatcher(None, key, kept[k], False).ratio() >= ratio for k in np.flatnonzero(most >= ratio * (sizes[:n] + len(key)) - 1e-9).tolist()):
                continue
            if n == len(sizes):
                counts, sizes = np.concatenate([counts, np.zeros_like(counts)]), np.concatenate([sizes, np.zeros_like(sizes)])
            counts[n], sizes[n] = own, len(key)
            kept.append(key)
        seen.add(key)
        out.append(no)
    return out


def near_line_dedup(lines: DataFrame, ratio: float = 0.9, least: int = 6) -> DataFrame:
    """(doc_id, line_no): lines kept after leaving out repeats, exact by key or nearly so, greedy in their order
    (:func:`kept_lines`). For lines that are rows; where documents are at hand :func:`document_lines` groups nothing."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_no")
        at = kept_lines(part["key"].tolist(), ratio, least)
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[0], "line_no": part["line_no"].iloc[at].astype("int32")})

    firsts = first_lines(lines).select("doc_id", "line_no", "key")
    return firsts.groupBy("doc_id").applyInPandas(keep, "doc_id long, line_no int")


def document_lines(docs: DataFrame, ratio: float = 0.9, least: int = 6) -> DataFrame:
    """(doc_id, line_no): :func:`near_line_dedup` of each document (doc_id, text), within its own row and without a shuffle."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.transform(F.split("text", "\n"), text_key).alias("keys"))

    def run(batches):
        for batch in batches:
            found = [kept_lines(keys, ratio, least) for keys in batch.column(1).to_pylist()]
            ids = np.repeat(np.array(batch.column(0), np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([no for x in found for no in x], pa.int32())], ["doc_id", "line_no"])

    return rows.mapInArrow(run, "doc_id long, line_no int")


def combined_lines(boards: DataFrame, ratio: float = 0.92, least: int = 6) -> DataFrame:
    """(board_id, pos, line_no, line): a board's lines without repeats, exact by key or nearly so.

    A repeat takes the place of the line that was there if its confidence is
    higher; no confidence counts as 0. ``line`` is the correction, else the
    text, trimmed; lines without letters and digits are left out. Input:
    board_id, text_lines. The lines of one board are compared with each other,
    behind upper bounds by length and by characters; no rows are grouped.
    """
    trimmed = F.transform("text_lines", lambda x: F.trim(F.coalesce(F.nullif(x["corrected_text"], F.lit("")), x["text"], F.lit(""))))
    conf = F.transform("text_lines", lambda x: F.coalesce(F.nanvl(x["confidence"], F.lit(0.0)), F.lit(0.0)).cast("double"))
    rows = boards.where("board_id is not null and size(text_lines) > 0").select("board_id", trimmed.alias("lines"), F.transform(trimmed, text_key).alias("keys"), conf.alias("conf"))

    def alike(a: str, b: str) -> bool:
        if a == b:
            return True
        if min(len(a), len(b)) < least or 2 * min(len(a), len(b)) < ratio * (len(a) + len(b)):
            return False
        m = difflib.SequenceMatcher(None, a, b, False)
        return m.quick_ratio() >= ratio and m.ratio() >= ratio

    def run(batches):
        for batch in batches:
            out = []
            for board, lines, keys, confs in zip(*(c.to_pylist() for c in batch.columns)):
                kept: list[int] = []
                for no, key in enumerate(keys):
                    at = next((p for p, k in enumerate(kept) if alike(key, keys[k])), None) if key else -1
                    if at is None:
                        kept.append(no)
                    elif at >= 0 and confs[no] > confs[kept[at]]:
                        kept[at] = no
                out += [(board, p, no, lines[no]) for p, no in enumerate(kept)]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["board_id", "pos", "line_no", "line"])

    return rows.mapInArrow(run, "board_id long, pos int, line_no int, line string")
