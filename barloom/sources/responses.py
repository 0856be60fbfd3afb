"""Validation of extracted events: the first JSON object of a response, closed vocabularies, evidence."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = ("event_type", "direction", "magnitude", "certainty", "time_horizon", "entity_role")
OUT = "id string, valid boolean, n_dropped int, events array<struct<event_type: string, direction: string, magnitude: string, certainty: string, time_horizon: string, entity_role: string, explicit_tickers: array<string>, evidence_text: string>>"


def first_object(text: str) -> dict | None:
    """The first JSON object inside prose, or None."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def check(source: str | None, response: str | None, ontology: dict[str, list[str]], universe: list[str]) -> tuple[bool, int, list[dict]]:
    """(valid, dropped, events): a response is valid when it holds an object with a list of events; an event
    is dropped when a slot is outside its vocabulary or its evidence is not in the source."""
    found = first_object(response or "")
    if found is None or not isinstance(found.get("events"), list):
        return False, 0, []
    kept, dropped = [], 0
    plain = " ".join((source or "").split())
    for event in found["events"]:
        slots = {s: str(event.get(s, "")).strip().lower() for s in SLOTS} if isinstance(event, dict) else {}
        evidence = " ".join(str(event.get("evidence_text", "")).split()) if slots else ""
        if not slots or not evidence or evidence not in plain or any(slots[s] not in ontology[s] for s in SLOTS):
            dropped += 1
            continue
        named = event.get("explicit_tickers") if isinstance(event.get("explicit_tickers"), list) else []
        kept.append(slots | {"explicit_tickers": sorted({str(t).upper() for t in named} & set(universe)), "evidence_text": evidence})
    return True, dropped, kept


def _validated(batches: Iterator[pa.RecordBatch], ontology: dict[str, list[str]], universe: list[str]) -> Iterator[pa.RecordBatch]:
    event = pa.struct([*((s, pa.string()) for s in SLOTS), ("explicit_tickers", pa.list_(pa.string())), ("evidence_text", pa.string())])
    for batch in batches:
        rows = [check(s, r, ontology, universe) for s, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(event))], ["id", "valid", "n_dropped", "events"])


def validated(df: DataFrame, id_col: str, source: str, response: str, ontology: dict[str, list[str]], universe: list[str]) -> DataFrame:
    """id, valid, n_dropped, events of every response; null texts make an invalid response."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source).alias("s"), F.col(response).alias("r"))
    return rows.mapInArrow(partial(_validated, ontology=ontology, universe=universe), OUT)


def _flat(value, out: list[str]) -> None:
    """Texts of a nested news cell in order; headline and body of one object are one text."""
    if value is None:
        return
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in "[{":
            for load in (json.loads, ast.literal_eval):
                try:
                    return _flat(load(text), out)
                except (ValueError, SyntaxError):
                    continue
        if text:
            out.append(text)
    elif isinstance(value, dict):
        parts = [str(value[k]).strip() for k in ("headline", "title", "summary", "body", "text", "content") if isinstance(value.get(k), str) and value[k].strip()]
        if parts:
            out.append(" ".join(parts))
        else:
            for v in value.values():
                _flat(v, out)
    elif isinstance(value, (list, tuple)):
        for v in value:
            _flat(v, out)
    else:
        out.append(str(value))


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for cell in batch.column(1).to_pylist():
            found: list[str] = []
            _flat(cell, found)
            texts.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], ["id", "texts"])


def flattened(df: DataFrame, id_col: str, cell: str) -> DataFrame:
    """id, position, text: the texts of nested news cells (text, JSON or Python literals, lists, objects)."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(cell).cast("string").alias("cell"))
    return rows.mapInArrow(_flattened, "id string, texts array<string>").select("id", F.posexplode("texts").alias("position", "text"))
