"""Chat formatting with typed content parts.

A message's content is a list of parts (text, image, audio, document).  A visitor walks the parts
in order: texts are escaped and appended, every other part leaves a numbered placeholder, an
attachment reference and the number of tokens that it expands to.  The template marks role and
text of each turn with control strings that escaped text can't contain, so that the output can be
read back exactly; character spans of assistant texts make up the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.common import small_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that may not occur in a text as they are; one backslash is put into each.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Expansion of attachments: pixels of an image patch's side, audio tokens a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
MESSAGE = "conv_id long, turn long, role string, parts array<" + PART + ">"

_ESCAPE = re.compile(r"\\|(?=(?:" + "|".join(map(re.escape, CONTROL)) + r"))(.)", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HOLE = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    """Backslashes are doubled and every control string is broken after its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


class PartVisitor:
    """Flattens one message's parts; ``visit`` goes by the part's type.

    Adjacent texts are escaped as one text, since a control string may begin in one part and end in
    the next; ``pieces`` are complete after ``finish``.
    """

    def __init__(self):
        self.pieces: list[tuple[str, bool]] = []  # escaped text or placeholder, and whether it is text
        self.attachments: list[dict] = []
        self.texts: list[str] = []  # the open run of adjacent texts

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part or {})

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def finish(self) -> PartVisitor:
        """Closes the open run of texts."""
        if joined := "".join(self.texts):
            self.pieces.append((escape(joined), True))
        self.texts = []
        return self

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.finish()
        at = len(self.attachments)
        self.pieces.append((f"<|{kind}:{at}|>", False))
        self.attachments.append({"position": at, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def format_message(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """One turn's segment, its loss spans (texts of assistant turns) and its attachments."""
    visitor = PartVisitor()
    for part in parts or []:
        visitor.visit(part)
    visitor.finish()
    out = f"{TURN}{escape(role or '')}{SAYS}"
    spans = []
    for piece, is_text in visitor.pieces:
        if is_text and role == "assistant":
            spans.append((len(out), len(out) + len(piece)))
        out += piece
    return out + END, spans, visitor.attachments


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text (placeholders taken out) of a formatted turn."""
    body = segment.removeprefix(TURN).removesuffix(END)
    role, _, text = body.partition(SAYS)
    return unescape(role), unescape(_HOLE.sub("", text))


FORMATTED = "conv_id long, turn long, segment string, loss_spans array<struct<start:int,end:int>>, attachments string, expanded_tokens long"


def format_turns(messages: DataFrame) -> DataFrame:
    """One row per message of (conv_id, turn, role, parts): its segment of the formatted conversation.

    A conversation is the concatenation of its segments by turn (nulls first, then role and segment
    where turns tie), so turns are formatted where they lie, whatever a conversation's length.
    ``loss_spans`` count characters within the segment; ``attachments`` is a JSON list.  Null roles
    and texts are empty; a part of unknown type counts as text.
    """
    small_batches(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_message(r, p) for r, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            spans = pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in made], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in made], pa.string()), spans, pa.array([json.dumps(x[2]) for x in made], pa.string()), pa.array([sum(a["tokens"] for a in x[2]) for x in made], pa.int64())],
                ["conv_id", "turn", "segment", "loss_spans", "attachments", "expanded_tokens"],
            )

    return messages.select("conv_id", "turn", "role", "parts").mapInArrow(run, FORMATTED)


def text_messages(rows: DataFrame) -> DataFrame:
    """Messages of one text part each from rows of (conv_id, turn, role, text)."""
    text = "named_struct('type', 'text', 'text', coalesce(CAST(text AS string), ''), " + _nothing() + ")"
    return rows.selectExpr("CAST(conv_id AS long) conv_id", "CAST(turn AS long) turn", "CAST(role AS string) role", f"array({text}) parts")


def _nothing(*given: str) -> str:
    return ", ".join(f"'{c}', CAST(NULL AS {t})" for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")) if c not in given)


def page_messages(pages: DataFrame) -> DataFrame:
    """A question and an answer about each row of (page_id, url, html), whose parts are typed.

    The question is the url, a document part of one page for each link target in the html, and a
    closing text; the answer is the number of links and the url, as two adjacent texts.  Null url and
    html are empty.
    """
    text = lambda x: f"named_struct('type', 'text', 'text', {x}, {_nothing()})"
    link = "named_struct('type', 'document', 'text', CAST(NULL AS string), 'ref', x, 'width', CAST(NULL AS int), 'height', CAST(NULL AS int), 'seconds', CAST(NULL AS double), 'pages', 1)"
    rows = pages.selectExpr("CAST(page_id AS long) conv_id", "coalesce(CAST(url AS string), '') url", "regexp_extract_all(coalesce(CAST(html AS string), ''), 'href=\"([^\"]*)\"', 1) links")
    asked = f"concat(array({text('url')}), transform(links, x -> {link}), array({text(repr('What do these say?'))}))"
    answer = f"array({text('CAST(size(links) AS string)')}, {text('url')})"
    turns = f"inline(array(struct(0L, 'user', {asked}), struct(1L, 'assistant', {answer}))) AS (turn, role, parts)"
    return rows.selectExpr("conv_id", turns)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments: turns, loss text and lengths as digests.

    Segments arrive sorted and are read one at a time, so a conversation of any length needs the
    memory of its longest turn.  An empty table gives no rows; null conv_ids are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> list:
            return [current, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens]

        started, out = False, []
        current = turns = loss = None
        n = chars = size = tokens = 0
        for b in batches:
            for conv, segment, spans, expanded in zip(*(b.column(k).to_pylist() for k in range(4))):
                if not started or conv != current:
                    if started:
                        out.append(row())
                    started, current, turns, loss = True, conv, hashlib.sha256(), hashlib.sha256()
                    n = chars = size = tokens = 0
                role, text = read_segment(segment)
                turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    masked = unescape(segment[span["start"] : span["end"]])
                    loss.update(masked.encode())
                    chars += len(masked)
                n, size, tokens = n + 1, size + len(segment), tokens + expanded
            if len(out) >= 1000:
                yield _digest_rows(out)
                out = []
        if started:
            out.append(row())
        yield _digest_rows(out)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "segment")
    return ordered.select("conv_id", "segment", "loss_spans", "expanded_tokens").mapInArrow(run, DIGEST)


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in DIGEST.split(", ")])
