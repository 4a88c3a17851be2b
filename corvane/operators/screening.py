"""Proposal tables: lenient parsing, schema rules, and screening decisions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the proposal format.
FIELDS = ("Intent_Class", "Target_File", "Topological_Grounding", "Implementation_Block", "Safety_Abort")
INTENTS = ("FIX", "REFACTOR", "TEST", "DOC", "SPEC")
ABORTS = ("NONE", "BOUNDARY_VIOLATION", "SYNTAX_ERROR", "UNAUTHORIZED_SCOPE")
GROUNDED = ("REFACTOR", "FIX", "AUDIT")
DENIED = (
    "fetch(", "axios", "urllib.request", "import requests", "httpx", "socket", "urllib3", "subprocess", "curl", "wget", "aiohttp",
    "importlib", "os.system", "os.popen", "requests.", "http.client", "webbrowser", "telnet", "nc ", "ftp", "xmlrpc",
)
ZERO_TRUST, SAFETY_GATE, UNGROUNDED = "ABORTED_VIOLATES_ZERO_TRUST", "BLOCKED_BY_SAFETY_GATE", "ABORTED_GROUNDING_FAILED"

SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


DECODER = json.JSONDecoder()
FENCE = re.compile(r"```(?:json)?[ \t]*\n(.*?)```", re.S)


def recover(text: str) -> tuple[str | None, bool]:
    """The JSON text of a fence or of the first object in a text, and whether it had to be repaired.

    The decoder finds an object's end.  Where it stops at a comma before a closing
    bracket, the comma is dropped; where it stops at the end, a brace is added.
    """
    fenced = FENCE.search(text)
    own = fenced[1] if fenced else text
    start = own.find("{")
    if start < 0:
        return None, False
    own, repaired = own[start:].rstrip(), False
    # every repair takes away a comma or closes a brace
    for _ in range(own.count(",") + own.count("{") + 1):
        try:
            _, end = DECODER.raw_decode(own)
            return own[:end], repaired
        except ValueError as fault:
            at = fault.pos
        before = own[: at + 1].rstrip()
        comma = len(before) - 1 if before.endswith(",") else own[:at].rstrip().rfind(",")
        if comma >= 0 and own[comma + 1 :].lstrip()[:1] in ("}", "]") and comma >= len(own[:at].rstrip()) - 1:
            own = own[:comma] + own[comma + 1 :]
        elif at >= len(own):
            own = (own[:-1] if own.endswith(",") else own) + "}"
        else:
            break
        repaired = True
    return None, False


def parse_proposals(raw: DataFrame) -> DataFrame:
    """Adds json, status and used_repair; only rows that native parsing fails on go through Python."""
    whole = F.trim(F.col("raw"))
    # an array or a plain value is JSON too
    parsed = raw.withColumn("direct", F.get_json_object("raw", "$").isNotNull() & F.when(whole.startswith("{"), whole.endswith("}")).when(whole.startswith("["), whole.endswith("]")).otherwise(whole.rlike(r'^(-?[0-9.eE+-]+|"[^"]*"|true|false|null)$')))

    @F.pandas_udf("json string, status string, used_repair boolean")
    def mend(text: pd.Series) -> pd.DataFrame:
        found = [(None, None, None) if t is None else recover(t) for t in text]
        return pd.DataFrame([(None,) * 3 if f[0] is None and len(f) == 3 else (f[0], "FAILED" if f[0] is None else "REPAIRED" if f[1] else "EXTRACTED", f[1]) for f in found], columns=["json", "status", "used_repair"])

    # read once: the column is null where native parsing worked
    direct = F.coalesce("direct", F.lit(False))
    mended = parsed.withColumn("m", mend(F.when(~direct, F.coalesce("raw", F.lit("")))))
    return mended.select(*raw.columns, F.when(direct, F.col("raw")).otherwise(F.col("m.json")).alias("json"), F.when(direct, "DIRECT").otherwise(F.col("m.status")).alias("status"), F.when(direct, False).otherwise(F.col("m.used_repair")).alias("used_repair"))


def proposal_outcome(raw: DataFrame) -> DataFrame:
    """Adds outcome: VALID, VALIDATION_ERROR for readable JSON that breaks the schema, PARSING_ERROR for JSON that can't be read or only breaks it after repair."""
    parsed = parse_proposals(raw)
    judged = validate_proposals(parsed.withColumnRenamed("raw", "__given").withColumn("raw", F.col("json")))
    error = F.col("json").isNull() | (F.col("used_repair") & ~F.col("valid"))
    outcome = F.when(error, "PARSING_ERROR").when(F.col("valid"), "VALID").otherwise("VALIDATION_ERROR")
    return judged.withColumn("outcome", outcome).drop("raw", "valid").withColumnRenamed("__given", "raw").select(*raw.columns, "status", "outcome")


def validate_proposals(raw: DataFrame) -> DataFrame:
    """All five fields, no others, and known intents and aborts."""
    keys = F.json_object_keys("raw")
    p = raw.withColumn("keys", keys).withColumn("p", F.from_json("raw", SCHEMA))
    exact = (F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) == 0) & (F.size(F.array_except(F.array(*map(F.lit, FIELDS)), "keys")) == 0)
    return p.withColumn("valid", F.coalesce(exact & F.col("p.Intent_Class").isin(*INTENTS) & F.col("p.Safety_Abort").isin(*ABORTS), F.lit(False))).drop("keys", "p")


def screen_proposals(raw: DataFrame, files: DataFrame) -> DataFrame:
    """One decision for each proposal, by precedence; files are (path, content).

    Proposals are parsed leniently first, and the rules judge parsed values.  A
    field that is missing counts as empty (``NONE`` for intent and abort); JSON that is
    no object, or whose block is null, can't be grounded.
    """
    p = parse_proposals(raw).withColumn("m", F.from_json("json", "map<string,string>"))
    value = lambda name: F.try_element_at("m", F.lit(name))
    given = lambda name: F.map_contains_key("m", F.lit(name))
    fields = {"__target": value("Target_File"), "__block": value("Implementation_Block"), "__quote": value("Topological_Grounding"), "__intent": value("Intent_Class"), "__abort": F.when(given("Safety_Abort"), F.coalesce(value("Safety_Abort"), F.lit("null"))).otherwise("NONE")}
    joined = p.withColumns(fields).join(files.select(F.col("path").alias("__path"), F.col("content").alias("__content")), F.col("__target") == F.col("__path"), "left")
    denied = F.lit(False)
    for token in DENIED:
        denied = denied | F.coalesce(F.col("__block").contains(token), F.lit(False))
    grounded = F.coalesce((F.col("__quote") != "") & F.contains(F.col("__content"), F.col("__quote").cast("binary")), F.lit(False))
    nul = F.exists(F.map_values("m"), lambda v: F.coalesce(v.contains("\0"), F.lit(False)))
    decision = (
        F.when(F.col("raw").contains("\0"), ZERO_TRUST).when(F.col("json").isNull(), "INVALID_JSON").when(F.col("m").isNull(), UNGROUNDED).when(nul, ZERO_TRUST).when(F.col("__abort") != "NONE", SAFETY_GATE)
        .when(denied, ZERO_TRUST).when(given("Implementation_Block") & F.col("__block").isNull(), UNGROUNDED).when(F.col("__intent").isin(*GROUNDED) & ~grounded, UNGROUNDED).otherwise("EXECUTE_SAFE")
    )
    return joined.withColumn("decision", decision).select(*raw.columns, "decision")
