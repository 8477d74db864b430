"""Reading model responses: the first answer block, its JSON, its faults.

Faults are codes with the target or item they concern (``T01:text_too_long``);
the reason for a retry follows from the whole list.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa

from textgauge.functions.arrow import text_function
from textgauge.functions.runs import longest_runs

STATUSES = ("carrier_not_found", "text_unreadable", "transcribed")
TEXT_LIMIT = 640
ITEM_IDS = tuple(f"C{k:02d}" for k in range(1, 21))
_BLOCK = re.compile(r"<answer>\s*(.*?)\s*</answer>", re.DOTALL | re.IGNORECASE)
_SPACES = re.compile(r"\s{64,}")

# What a model is told after a failed attempt.
TRANSCRIPTION_FEEDBACK = {
    "unclosed_answer_repetition": "Your previous attempt failed because the <answer>...</answer> block was not closed and the output entered a repetition loop. Please correct this in the current attempt.",
    "transcription_too_long": "Your previous attempt failed because a single transcription text value was too long and likely hallucinated. Please correct this in the current attempt.",
    "field_conflict": "Your previous attempt failed because the output fields conflicted with the required constraints. Please correct this in the current attempt.",
    "other": "Your previous attempt failed. Please correct the output in the current attempt.",
}
CHECKLIST_FEEDBACK = {
    "incomplete_answer_block": "Your previous attempt failed because the required <answer>...</answer> block was incomplete, likely due to truncation or repetition. Please correct this in the current attempt.",
    "invalid_json": "Your previous attempt failed because the content inside <answer>...</answer> was not valid JSON. Please correct this in the current attempt.",
    "invalid_answer_label": "Your previous attempt failed because one or more answers were not yes or no. Please correct this in the current attempt.",
    "other": "Your previous attempt failed. Please correct the output in the current attempt.",
}


def blocks(raw: str) -> dict:
    """The first complete block's content and what stands around it."""
    found = list(_BLOCK.finditer(raw))
    head = found[0] if found else None
    return {
        "block_count": len(found),
        "content": head[1] if head else None,
        "text_before": bool((raw[: head.start()] if head else raw).strip()),
        "text_after": bool(head and raw[head.end() :].strip()),
    }


def _loads(content: str | None):
    """(read, value); a missing or broken text is not read."""
    try:
        return (False, None) if content is None else (True, json.loads(content))
    except (json.JSONDecodeError, RecursionError):
        return False, None


def loops(raw: str) -> bool:
    """Whether a raw text looks like a repetition loop."""
    run, unit = longest_runs([raw])[0]
    return bool(run and run[3] >= 64) or unit is not None or _SPACES.search(raw) is not None


# ------------------------------------------------------------------ transcription


def _target_faults(value) -> list[str]:
    """Faults of one target's value: one about its text and one about its note at most."""
    if not isinstance(value, dict):
        return ["not_an_object"]
    if set(value) != {"status", "text", "readability_note"}:
        return ["wrong_fields"]
    status, text, note = value["status"], value["text"], value["readability_note"]
    known = isinstance(status, str) and status in STATUSES
    spoken, unread, lost = (known and status == s for s in ("transcribed", "text_unreadable", "carrier_not_found"))
    about_text = next(
        (
            code
            for code, wrong in (
                ("text_not_string", not isinstance(text, str)),
                ("text_too_long", isinstance(text, str) and len(text) > TEXT_LIMIT),
                ("text_has_placeholder", isinstance(text, str) and "<UNK>" in text),
                ("text_blank", spoken and isinstance(text, str) and not text.strip()),
                ("text_not_empty", (unread or lost) and text != ""),
            )
            if wrong
        ),
        None,
    )
    about_note = next(
        (
            code
            for code, wrong in (
                ("note_not_string", not isinstance(note, str)),
                ("note_missing", unread and isinstance(note, str) and not note.strip()),
                ("note_not_empty", lost and note != ""),
            )
            if wrong
        ),
        None,
    )
    return [c for c in (None if known else "invalid_status", about_text, about_note) if c]


def _lenient(value) -> tuple[str, str, str]:
    """Status, text and note to score when no attempt is left."""
    value = value if isinstance(value, dict) else {}
    text, status, note = (value.get(k) for k in ("text", "status", "readability_note"))
    note = note if isinstance(note, str) else ""
    if isinstance(text, str) and text:
        return "transcribed", text, note
    return (status if isinstance(status, str) and status in STATUSES else "text_unreadable"), "", note


def read_transcription(raw: str | None, ids: list[str], finish_reason: str | None) -> dict:
    raw = raw or ""
    b = blocks(raw)
    read, value = _loads(b["content"])
    parsed = read and isinstance(value, dict)
    faults: list[str] = []
    if not parsed:
        faults.append("no_answer_block" if not b["block_count"] else "not_a_json_object" if read else "invalid_json")
    else:
        if list(value) != list(ids):
            faults.append("ids_or_order")
        faults += [f"{i}:{code}" for i in ids for code in _target_faults(value.get(i))]
    reason = None
    if faults:
        low = raw.lower()
        unclosed = not b["block_count"] and "<answer>" in low and "</answer>" not in low
        if unclosed and (finish_reason == "length" or loops(raw)):
            reason = "unclosed_answer_repetition"
        elif any(f.endswith(":text_too_long") for f in faults):
            reason = "transcription_too_long"
        else:
            reason = "field_conflict" if parsed else "other"
    answer = [(i, *_lenient(value.get(i))) for i in ids] if parsed else None
    return {**{k: b[k] for k in ("block_count", "text_before", "text_after")}, "parsed": parsed, "errors": faults, "reason": reason, "answer": answer}


# ------------------------------------------------------------------ checklist


def plain_id(found, expected: str):
    """A padded id such as C010 at the place of C10 counts as C10."""
    padded = isinstance(found, str) and len(found) == 4 and found.startswith("C0") and found[2:] == expected[1:] and 10 <= int(expected[1:]) <= 20
    return expected if padded else found


def read_checklist(raw: str | None, ids: list[str] | tuple[str, ...] = ITEM_IDS, padded: bool = True) -> dict:
    b = blocks(raw or "")
    content = b["content"].strip() if b["content"] is not None else None
    read, value = _loads(content)
    repaired = False
    if not read and content and content[0] == "[" and content[-1] != "]":
        read, value = _loads(content + "]")
        repaired = read
    faults, decisions = [], []
    if not read or not isinstance(value, list):
        faults.append("no_answer_block" if not b["block_count"] else "not_an_array" if read else "invalid_json")
    else:
        if len(value) != len(ids):
            faults.append("item_count")
        for place, want in enumerate(ids):
            item = value[place] if place < len(value) else None
            if not isinstance(item, dict):
                faults.append(f"{want}:{'not_an_object' if place < len(value) else 'missing'}")
                continue
            if set(item) != {"id", "answer"}:
                faults.append(f"{want}:wrong_fields")
            name = item.get("id")
            if (plain_id(name, want) if padded else name) != want:
                faults.append(f"{want}:id_or_order")
            answer = item.get("answer")
            label = answer.strip().lower() if isinstance(answer, str) else None
            if label in ("yes", "no"):
                decisions.append((want, label))
            else:
                faults.append(f"{want}:answer_label")
        if len(value) > len(ids):
            faults.append("extra_items")
    reason = None
    if faults:
        reason = (
            "incomplete_answer_block"
            if not b["block_count"]
            else "invalid_json"
            if "invalid_json" in faults
            else "invalid_answer_label"
            if any(f.endswith(":answer_label") for f in faults)
            else "other"
        )
    return {**{k: b[k] for k in ("block_count", "text_before", "text_after")}, "parsed": read, "repaired": repaired, "errors": faults, "reason": reason, "decisions": None if faults else decisions}


_HEAD = "block_count:int,text_before:boolean,text_after:boolean,parsed:boolean"
TRANSCRIPTION = f"struct<{_HEAD},errors:array<string>,reason:string,answer:array<struct<id:string,status:string,text:string,readability_note:string>>>"
CHECKLIST = f"struct<{_HEAD},repaired:boolean,errors:array<string>,reason:string,decisions:array<struct<id:string,answer:string>>>"


_HEAD_KIND = [("block_count", pa.int32()), ("text_before", pa.bool_()), ("text_after", pa.bool_()), ("parsed", pa.bool_())]


def _rows(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.string()) for n in names]))


def _named(rows: list[tuple] | None, *names: str) -> list[dict] | None:
    return None if rows is None else [dict(zip(names, r, strict=True)) for r in rows]


_ANSWER, _DECISION = ("id", "status", "text", "readability_note"), ("id", "answer")


@text_function(TRANSCRIPTION, pa.struct([*_HEAD_KIND, ("errors", pa.list_(pa.string())), ("reason", pa.string()), ("answer", _rows(*_ANSWER))]))
def transcription(raw, ids, finish_reason):
    from textgauge.functions import answers

    r = answers.read_transcription(raw, ids or [], finish_reason)
    return {**r, "answer": answers._named(r["answer"], *answers._ANSWER)}


@text_function(CHECKLIST, pa.struct([*_HEAD_KIND, ("repaired", pa.bool_()), ("errors", pa.list_(pa.string())), ("reason", pa.string()), ("decisions", _rows(*_DECISION))]))
def checklist(raw):
    from textgauge.functions import answers

    r = answers.read_checklist(raw)
    return {**r, "decisions": answers._named(r["decisions"], *answers._DECISION)}
