"""Citations: numbered evidence, verification of answers against it, and the question loop."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_MARK = r"\[(\d+(?:, ?\d+)*)\]"
INSUFFICIENT = "There is not enough evidence to answer this question."
NO_EVIDENCE = "No evidence was found."


def verify_citations(text: Column, count: Column) -> Column:
    """struct valid, cited, reason: every line that isn't blank needs a mark [n] or [n, m], and every
    number must be one of 1..count. A null or blank text is an empty answer."""
    lines = F.filter(F.split(text, _LINES), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    numbers = F.transform(
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_MARK), F.lit(1)), lambda m: F.split(m, ", ?"))), lambda n: F.coalesce(F.try_to_number(n, F.lit("9999999999")).cast("long"), F.lit(-1).cast("long"))
    )
    blank = F.coalesce(F.size(lines) == 0, F.lit(True)) | text.isNull()
    uncited = F.exists(lines, lambda x: ~x.rlike(_MARK))
    outside = F.exists(numbers, lambda n: (n < 1) | (n > count))
    reason = F.when(blank, "empty answer").when(uncited, "uncited line").when(outside, "citation out of range").otherwise("")
    cited = F.sort_array(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= count))))
    return F.struct((reason == "").alias("valid"), F.coalesce(cited, F.array().cast("array<bigint>")).alias("cited"), reason.alias("reason"))


def verify_text(text: str, count: int) -> tuple[bool, set[int], str]:
    """The same for one answer, on the driver."""
    lines = [x for x in text.splitlines() if x.strip()]
    numbers = {int(n) for m in re.findall(_MARK, text) for n in re.split(", ?", m)}
    inside = {n for n in numbers if 1 <= n <= count}
    reason = "empty answer" if not lines else "uncited line" if any(not re.search(_MARK, x) for x in lines) else "citation out of range" if numbers - inside else ""
    return not reason, inside, reason


@dataclass
class EvidenceRegistry:
    """A number for each (entity_type, entity_id), given at first sight and kept."""

    items: dict = field(default_factory=dict)

    def add(self, rows: list) -> list[int]:
        return [self.items.setdefault((r["entity_type"], str(r["entity_id"])), (len(self.items) + 1, r))[0] for r in rows]

    def all(self) -> list:
        return [self.items[k] for k in self.items]


def evidence_block(items: list) -> str:
    """The numbered items as text, each with its source."""
    if not items:
        return NO_EVIDENCE
    out = []
    for number, r in items:
        out.append(f"[{number}] ({r['entity_type']}) {r['content']}")
        source, sure = r.get("source"), r.get("entity_resolution_confidence")
        if source:
            out.append(f"    source: {source}")
        if sure is not None:
            out.append(f"    entity resolution confidence: {sure:.2f}")
    return "\n".join(out)


def ask(question: str, search: Callable[[str], list], model: Callable[[list, str | None], dict], turns: int = 4) -> dict:
    """A model is asked with a search tool, at most `turns` times; its answer counts only if its
    citations hold. model(messages, tool result) gives {'query': ...} or {'text': ...}."""
    registry, messages, result = EvidenceRegistry(), [question], None
    for _ in range(turns):
        said = model(messages, result)
        if "query" in said:
            if not said["query"].strip():
                result = "The query was empty."
                continue
            registry.add(search(said["query"]))
            result = evidence_block(registry.all())
            messages.append(result)
            continue
        text = said.get("text") or ""
        valid, cited, _ = verify_text(text, len(registry.items))
        if valid and text.strip() != INSUFFICIENT:
            return {"text": text, "references": [r for n, r in registry.all() if n in cited], "insufficient_evidence": False}
        break
    return {"text": INSUFFICIENT, "references": [], "insufficient_evidence": True}
