"""The model as a table function: an interface, and a deterministic stand-in that needs no network.

Answers are untrusted text: functions.json_text recovers and checks their JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A provider takes one prompt and gives one answer; it runs on the executors, once per row.
Provider = Callable[[str], str]


@dataclass(frozen=True)
class Limits:
    max_prompt_chars: int = 64_000


def fake_provider(prompt: str) -> str:
    """The rows of the first pipe table of a prompt whose header has 'segment' first, as JSON."""
    rows, header = [], None
    for line in prompt.splitlines():
        cells = [c.strip() for c in line.split("|")] if "|" in line else None
        if not cells:
            header = None
        elif header is None and "segment" in cells[0].lower():
            header = cells
        elif header and cells[0] and cells[0].lower() not in ("total", "subtotal") and any(ch.isdigit() for ch in cells[-1]):
            rows.append({"segment_name": cells[0], "revenue_raw": cells[1], "evidence_text": line.strip()})
    return json.dumps({"rows": rows})


def answers(prompts: DataFrame, provider: Provider = fake_provider, limits: Limits = Limits()) -> DataFrame:
    """id, answer, error, chars_in, chars_out for prompts(id, prompt). A failing call gives a null answer and its error."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, p in zip(batch["id"], batch["prompt"]):
                try:
                    a, e = provider((p or "")[: limits.max_prompt_chars]), None
                except Exception as x:  # noqa: BLE001
                    a, e = None, str(x)[:500]
                out.append((i, a, e, len(p or ""), len(a or "")))
            yield pd.DataFrame(out, columns=["id", "answer", "error", "chars_in", "chars_out"])

    return prompts.select("id", "prompt").mapInPandas(call, "id string, answer string, error string, chars_in int, chars_out int")


#: A reader takes a document id and a page number and gives the page's text, or None; it may start a process of its own.
PageReader = Callable[[str, int], str | None]


def fallback_texts(pages: DataFrame, reader: PageReader) -> DataFrame:
    """id, text, status for pages(id, document_id, page_number): the reader's text, and whether it was applied, empty or failed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, d, n in zip(batch["id"], batch["document_id"], batch["page_number"]):
                try:
                    t = reader(d, int(n))
                    out.append((i, t, "applied" if t and t.strip() else "attempted_no_text"))
                except Exception:  # noqa: BLE001
                    out.append((i, None, "failed"))
            yield pd.DataFrame(out, columns=["id", "text", "status"])

    return pages.where(F.col("page_number").isNotNull()).select("id", "document_id", "page_number").mapInPandas(read, "id string, text string, status string")
