"""The seam to language models: an injected function over batches. No network and no model come with the library."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.tables import Table, stored

Ask = Callable[[list[str]], list[str]]

#: Columns of a store of responses, whose key is the hash of the prompt.
RESPONSES = "prompt_sha256 string, response string, failed boolean, error string"


def _patient(ask: Ask, prompts: list[str], tries: int, pause: float) -> list[tuple[str, str | None]]:
    """(response, error) of each prompt: a batch that fails is tried again after growing pauses, and at last prompt by prompt."""
    for n in range(tries):
        try:
            found = ask(prompts)
            if len(found) != len(prompts):
                raise ValueError(f"{len(found)} responses to {len(prompts)} prompts")
            return [(x, None) for x in found]
        except Exception as e:  # noqa: BLE001 - a failing server must not lose the batch's rows
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(pause * 2**n)
    if len(prompts) == 1:
        return [("", error)]
    return [_patient(ask, [p], 1, pause)[0] for p in prompts]


def answered(requests: DataFrame, make_client: Callable[[], Ask], batch: int = 16, tries: int = 1, pause: float = 1.0) -> DataFrame:
    """M1-M5: (id, prompt) -> (id, response, failed, error). A client is made once per task; what fails gives '' and the error's text.

    Null prompts are not asked and give ''.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_client()
        for f in frames:
            out, errors = [""] * len(f), [None] * len(f)
            todo = [i for i, p in enumerate(f["prompt"]) if isinstance(p, str)]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for i, (x, e) in zip(part, _patient(ask, [f["prompt"].iloc[i] for i in part], tries, pause), strict=True):
                    out[i], errors[i] = x, e
            yield pd.DataFrame({"id": f["id"], "response": out, "failed": [e is not None for e in errors], "error": pd.Series(errors, dtype=object)})

    kind = requests.schema["id"].dataType.simpleString()
    return requests.select("id", "prompt").mapInPandas(run, f"id {kind}, response string, failed boolean, error string")


def remembered(requests: DataFrame, store: Table, make_client: Callable[[], Ask], batch: int = 16, tries: int = 3, pause: float = 1.0, rounds: int = 8) -> DataFrame:
    """Requests with ``response`` ('' if there is none) and ``failed``, from a store of responses that outlives the run.

    store has the key prompt_sha256. Equal prompts are asked once; what the store holds is not asked again unless it failed. Missing
    prompts are asked in ``rounds`` parts, each of which is in the store once it is answered, so that a run that dies is taken up where it was.
    """
    hashed = requests.withColumn("prompt_sha256", F.sha2(F.col("prompt").cast("binary"), 256))
    wanted = hashed.where("prompt IS NOT NULL").groupBy("prompt_sha256").agg(F.min("prompt").alias("prompt"))
    have = store.read()
    if have is not None:
        wanted = wanted.join(have.where("NOT failed").select("prompt_sha256"), "prompt_sha256", "left_anti")
    wanted = stored(wanted.withColumn("_round", F.pmod(F.xxhash64("prompt_sha256"), F.lit(rounds))))
    for n in [r[0] for r in wanted.select("_round").distinct().orderBy("_round").collect()]:
        part = wanted.where(F.col("_round") == n).select(F.col("prompt_sha256").alias("id"), "prompt")
        store.upsert(stored(answered(part, make_client, batch, tries, pause)).withColumnRenamed("id", "prompt_sha256"))
    have = store.read()
    if have is None:
        return requests.withColumns({"response": F.lit(""), "failed": F.lit(False)})
    out = hashed.join(have.select("prompt_sha256", "response", "failed"), "prompt_sha256", "left")
    return out.withColumns({"response": F.coalesce("response", F.lit("")), "failed": F.coalesce("failed", F.lit(False))}).select(*requests.columns, "response", "failed")


def token_counter(texts: DataFrame, make_counter: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """P20 with a real tokenizer: (id, text) -> (id, tokens)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make_counter()
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "tokens": count([x if isinstance(x, str) else "" for x in f["text"]])})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, tokens long")
