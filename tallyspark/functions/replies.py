"""What goes to a language model and comes back: prompts, budgets, replies in many shapes, bounded texts."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

#: Bytes that a retry may add to a prompt, of these the error's own.
FEEDBACK, DETAIL = 1024, 512
RULES = "Answer with one JSON object and nothing else. Use only what the data says.\n"
# Members under which a reply may keep its text.
TEXT_KEYS = ("paragraphs", "text", "narrative", "summary", "content", "story")


class Truncated(RuntimeError):
    """The model came to its output limit every time."""


class Invalid(RuntimeError):
    """No reply met what was asked for."""


@dataclass(frozen=True)
class Reply:
    text: str
    error: str | None = None
    truncated: bool = False


@dataclass(frozen=True)
class Budget:
    """Sizes in bytes, a cautious bound for tokens."""

    context: int = 8192
    output: int = 1200
    margin: int = 256
    retries: int = 2

    def __post_init__(self):
        if min(self.context, self.output) < 1 or min(self.margin, self.retries) < 0 or self.output >= self.context:
            raise ValueError("sizes must be positive, the output smaller than the context")

    def room(self) -> int:
        """What is left for a prompt."""
        return self.context - self.output - self.margin - (FEEDBACK if self.retries else 0)


Model = Callable[[str, int], Reply]


@dataclass
class Caller:
    """Calls a model until its reply is valid; `events` tells of each attempt."""

    model: Model
    budget: Budget
    events: list[dict] = field(default_factory=list)

    def prompt(self, task: str, data: Any, error: str | None = None) -> str:
        again = ""
        if error:
            detail = error.encode()[:DETAIL].decode(errors="ignore")
            again = f"\nThe last answer was not accepted: {detail}\nAnswer anew and in full.\n"
        return f"{RULES}{task}{again}\nDATA\n{json.dumps(data, ensure_ascii=False)}"

    def fits(self, task: str, data: Any) -> bool:
        return len(self.prompt(task, data).encode()) <= self.budget.room()

    def call(self, task: str, data: dict, valid: Callable[[Any], Any], output: int | None = None, prose: bool = False) -> Any:
        """The first valid reply.  After a truncated one the output limit doubles, up to the budget's, and a word target in the data halves."""
        turn = Turn(data, self.budget.output if output is None else output)
        if not 1 <= turn.limit <= self.budget.output:
            raise ValueError("an output limit above the budget's")
        if not self.fits(task, data):
            raise ValueError("the prompt exceeds the budget")
        phase = task.splitlines()[0]
        for attempt in range(1, self.budget.retries + 2):
            reply = self.model(self.prompt(task, turn.data, turn.error), turn.limit)
            result, problem = _outcome(reply, valid, prose)
            self.events.append({"phase": phase, "call_number": len(self.events) + 1, "attempt": attempt, "response_text": reply.text, "error": problem, "truncated": reply.truncated})
            if problem is None:
                return result
            turn = turn.after(reply, problem, self.budget.output)
        raise (Truncated if reply.truncated else Invalid)(f"{phase}: {turn.error}")


@dataclass(frozen=True)
class Turn:
    """What is asked next: the data, the output limit, and what was wrong with the last answer."""

    data: dict
    limit: int
    error: str | None = None

    def after(self, reply: Reply, problem: str, most: int) -> Turn:
        if not reply.truncated:
            return replace(self, error=problem)
        words = self.data.get("max_words")
        shorter = self.data if words is None else {**self.data, "max_words": max(8, words // 2)}
        return Turn(shorter, min(most, 2 * self.limit), f"the answer was cut off; write less. {problem}")


def _outcome(reply: Reply, valid: Callable[[Any], Any], prose: bool) -> tuple[Any, str | None]:
    """What a reply holds, or what is wrong with it.  A truncated one may be valid all the same, though not as prose."""
    if reply.error and not reply.truncated:
        return None, reply.error
    try:
        return valid(decoded(reply.text, prose and not reply.truncated)), None
    except (ValueError, TypeError, KeyError) as e:
        return None, str(e) or type(e).__name__


def decoded(text: str, prose: bool = False) -> Any:
    """The JSON of a reply, in a code fence or not; with `prose`, text that does not even look like JSON is taken as it is."""
    body = text.strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", body, re.S)
    body = fenced[1] if fenced else body
    try:
        out = json.loads(body, parse_constant=_no_constant)
    except json.JSONDecodeError:
        if prose and body and body[0] not in '{["`':
            return body
        raise
    if not prose and not isinstance(out, dict):
        raise ValueError("not a JSON object")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def required_text(value: Any, name: str, limit: int | None = None) -> str:
    if not isinstance(value, str) or not value.strip() or (limit and len(value) > limit):
        raise ValueError(f"{name}: a non-empty text is needed" + (f" of at most {limit} characters" if limit else ""))
    return value


#: How deep a reply may be nested.
DEEPEST = 6


def paragraphs(reply: Any) -> list[str]:
    """The paragraphs of a reply: a text, a list, or an object with one of the usual members, nested at most six deep."""
    out: list[str] = []
    todo: list[tuple[Any, int]] = [(reply, 0)]
    while todo:
        value, depth = todo.pop()
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        match value:
            case str() if value.strip():
                out += filter(None, map(str.strip, re.split(r"\n\s*\n", value)))
            case [_, *_]:
                todo += ((x, depth + 1) for x in reversed(value))
            case dict() if member := next((m for m in map(value.get, TEXT_KEYS) if m is not None), None):
                todo.append((member, depth + 1))
            case dict():
                raise ValueError(f"none of {', '.join(TEXT_KEYS)} with a text among {', '.join(map(str, list(value)[:10]))}")
            case _:
                raise ValueError("no paragraphs")
    return out


def short_title(text: str, limit: int = 100) -> str:
    """A text on one line, cut behind a word if it is too long."""
    line = " ".join(required_text(text, "title").split())
    if len(line) <= limit:
        return line
    whole = re.match(rf".{{1,{limit - 2}}}(?= )", line)
    return (whole[0] if whole else line[: limit - 1]) + "…"


def themes(reply: Any, most: int) -> list[dict]:
    """Themes with distinct titles; a missing description is the title."""
    rows = reply.get("themes")
    if not isinstance(rows, list) or not 1 <= len(rows) <= most:
        raise ValueError(f"1 to {most} themes are needed")
    out = []
    for i, r in enumerate(rows, 1):
        title = short_title(r["title"])
        description = r.get("description")
        out.append({"id": f"T{i:02d}", "title": title, "description": description if isinstance(description, str) and description.strip() else title})
    if len({t["title"].casefold() for t in out}) < len(out):
        raise ValueError("two themes have the same title")
    return out


def json_bytes(text: str) -> int:
    return len(json.dumps(text, ensure_ascii=False).encode())


def _sizes(text: str) -> list[int]:
    """Bytes of JSON of each prefix of a text, without the quotes."""
    return list(accumulate((json_bytes(c) - 2 for c in text), initial=0))


def bounded(text: str, size: int) -> str:
    """At most `size` bytes of JSON: as many sentences as fit, evenly spread with both ends, else groups of eight words, else the head."""
    if json_bytes(text) <= size:
        return text
    words = text.split()
    sentences = [x for x in map(str.strip, re.split(r"(?<=[.!?])\s+|\n+", text)) if x]
    for units in (sentences, [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]):
        picked = lambda n, units=units: [round(k * (len(units) - 1) / max(1, n - 1)) for k in range(n)]
        over = bisect_left(range(1, len(units)), True, key=lambda n, units=units: json_bytes(_joined(units, picked(n))) > size) + 1  # noqa: B023
        for n in range(over, 0, -1):  # sizes hardly ever fall as more is picked; so this ends at once
            if json_bytes(said := _joined(units, picked(n))) <= size:
                return said
    keep = bisect_right(_sizes(text), size - 2 - len("…".encode())) - 1
    return text[: max(0, keep)].rstrip() + "…"


def _joined(units: list[str], chosen: list[int]) -> str:
    """The chosen units, with a mark where some are left out."""
    links = ["" if k is None else " " if i == k + 1 else " … " for k, i in zip([None, *chosen], chosen, strict=False)]
    return "".join(link + units[i] for link, i in zip(links, chosen, strict=True))


def tail(text: str, size: int = 1600) -> str:
    """The end of a text in at most `size` bytes of JSON, from a word's start on."""
    line = " ".join(text.split())
    if json_bytes(line) <= size:
        return line
    back = _sizes(line[::-1][:size])
    end = line[len(line) - (bisect_right(back, size - 2) - 1) :]
    return end.split(" ", 1)[-1]


def capped(parts: list[str], words: int) -> list[str]:
    """Paragraphs of at most so many words in all; the last one ends with a sentence if it has one, else with a full stop."""
    before = list(accumulate((len(p.split()) for p in parts), initial=0))
    whole = bisect_right(before, words) - 1
    out, left = parts[:whole], words - before[whole]
    if whole == len(parts) or not left:
        return out
    head = re.match(rf"(?:\s*\S+){{{left}}}", parts[whole])[0]
    sentences = re.match(r"""(?s).*[.!?]["'’”)]*(?=\s|\Z)""", head)
    return [*out, sentences[0] if sentences else head.rstrip(",;:-") + "."]
