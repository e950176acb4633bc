"""Terminal output as a stream: escape sequences removed across chunk bounds, text redacted, appended."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import redact

_SEQUENCE = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[ -/]*[0-~]|[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]")
_OPEN = re.compile(r"\x1b(?:\[[0-?]*[ -/]*|[\]PX^_][^\x07\x1b]*\x1b?|[ -/]*)?\Z")


class Stripper:
    """feed() bytes, get text; what may still grow into a sequence, a character or CRLF waits. state() and restore() carry it over."""

    def __init__(self):
        self._decoder, self._held = codecs.getincrementaldecoder("utf-8")("replace"), ""

    def feed(self, data: bytes) -> str:
        text = self._held + self._decoder.decode(data)
        cut = _OPEN.search(text)
        at = cut.start() if cut else len(text)
        if at and text[at - 1 : at] == "\r":
            at -= 1
        self._held = text[at:]
        return self._clean(text[:at])

    def flush(self) -> str:
        text, self._held = self._held + self._decoder.decode(b"", True), ""
        return self._clean(_OPEN.sub("", text))

    @staticmethod
    def _clean(text: str) -> str:
        return _SEQUENCE.sub("", text).replace("\r\n", "\n").replace("\r", "\n")

    def state(self) -> tuple[str, bytes]:
        return self._held, self._decoder.getstate()[0]

    def restore(self, held: str, pending: bytes) -> None:
        self._held = held
        self._decoder.setstate((bytes(pending), 0))


def strip_bytes(data: bytes) -> str:
    s = Stripper()
    return s.feed(data) + s.flush()


def cleaned_stream(chunks: DataFrame) -> DataFrame:
    """chunks: session_id, seq, data. (session_id, seq, content) with state kept per session; works on streams."""

    def step(key, frames, state: GroupState):
        s = Stripper()
        if state.exists:
            s.restore(*state.get)
        for pdf in frames:
            pdf = pdf.sort_values("seq")
            yield pd.DataFrame({"session_id": key[0], "seq": pdf.seq, "content": [s.feed(bytes(x)) for x in pdf.data]})
        state.update(s.state())

    return chunks.groupBy("session_id").applyInPandasWithState(step, "session_id string, seq long, content string", "held string, pending binary", "append", GroupStateTimeout.NoTimeout)


def captured(events: DataFrame) -> DataFrame:
    """The capture path's projection for batch or stream: redacted content."""
    return events.withColumn("content", redact(F.col("content")))


def append(events: DataFrame, path: str, checkpoint: str):
    return captured(events).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
