"""The questionnaire about passages as a file, and the answer to it, which must be one to the same questions."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

HEADER = """# Which symbols do these {n} passages describe?

Answer with JSON: {{"ask": "{digest}", "picks": {{"passage": ["symbol id", ...]}}}}. Pick from a passage's candidates only;
an empty list says that none of them is meant. At most three picks count.
"""


def out_path(corpus: str, named: str | None = None, here: str | None = None) -> str:
    """Where a map goes: as named, else below the current folder, never into the corpus that it is about."""
    path = os.path.abspath(named or os.path.join(here or os.getcwd(), "symbolary-out", "map"))
    root = os.path.abspath(corpus)
    if path == root or path.startswith(root + os.sep) and named is not None:
        raise ValueError(f"{path} is inside the corpus {root}")
    return path


def write_ask(asked: DataFrame, digest: str, path: str) -> int:
    """Writes the kept blocks in reading order; gives how many. They fit a token budget, so they fit the driver."""
    blocks = [r.block for r in asked.where("kept").orderBy("place").select("block").collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n\n---\n\n".join([HEADER.format(n=len(blocks), digest=digest), *blocks]) + "\n")
    return len(blocks)


def load_answer(spark: SparkSession, path: str, digest: str) -> tuple[DataFrame, str]:
    """(passage, picks; null where it was no list) and why the answer can't be used, if it can't: then there are no rows."""
    none = spark.createDataFrame([], "passage string, picks array<string>")
    if not os.path.exists(path):
        return none, f"there is no answer at {path} yet"
    try:
        with open(path, encoding="utf-8") as f:
            answer = json.load(f)
    except json.JSONDecodeError as e:
        return none, f"the answer at {path} is no valid JSON: {e.msg}, line {e.lineno}"
    if not isinstance(answer, dict):
        return none, f"the answer at {path} is no JSON object"
    if str(answer.get("ask", "")) != digest:
        return none, f"the answer at {path} is to other questions ({answer.get('ask', '')!r}, these are {digest!r}): ask again"
    picks = answer.get("picks", {})
    rows = [(str(k), [x if isinstance(x, str) else None for x in v] if isinstance(v, list) else None) for k, v in (picks.items() if isinstance(picks, dict) else ())]
    return spark.createDataFrame(rows, none.schema), ""
