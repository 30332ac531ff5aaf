"""Structural role of text blocks: a cascade of rules, the first that holds wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions.text import trimmed, word_count

CLASSIFIER = "heuristic-screen-text-structure@1"

#: A classifier: blocks in, the same rows with role, confidence and reasons out.
Classifier = Callable[[DataFrame], DataFrame]

# Words, marks and reasons that the rules go by.
CODE_ANYWHERE = [" error ", " warning ", "exception", "stack trace"]
CODE_PREFIX = ["error", "warning"]
CODE_TOKENS = ["{", "}", "();", "=>", "==", "!=", "let ", "var ", "func ", "import "]
PRICE_MARKS = ["$", "USD", "EUR", "GBP", "%"]
AD_EXACT = ["sponsored", "promoted", "advertisement", "ad", "promoted post", "sponsored content"]
AD_PREFIX = ["sponsored by ", "promoted by "]
AD_ANYWHERE = [" sponsored content", " advertisement"]
BUTTON_EXACT = ["ok", "cancel", "done", "save", "send", "submit", "continue", "next", "back", "close", "apply", "confirm", "sign in", "log in", "create account", "get started", "learn more"]
BUTTON_PREFIX = ["save ", "add ", "create ", "open ", "view ", "start "]
LINK_PREFIX = ["http://", "https://"]
LINK_ANYWHERE = ["www.", ".com"]
LINK_EXACT = ["terms", "privacy", "forgot password?", "learn more"]
NAVIGATION_EXACT = ["home", "search", "settings", "profile", "account", "dashboard", "inbox", "help", "files", "edit", "view", "window"]
LABEL_EXACT = ["name", "email", "password", "username", "phone", "address", "company", "title", "description", "search", "date", "amount"]
PLACEHOLDER_PREFIX = ["enter ", "type ", "search ", "select ", "choose "]
TABLE_EXACT = ["status", "date", "name", "type", "amount", "total", "price", "owner", "created", "updated"]
METADATA_ANYWHERE = ["updated", "created", "edited", "version", "last seen"]
REASONS = {
    "empty": ["empty block text"],
    "codeOrLog": ["contains code or log punctuation patterns"],
    "priceOrNumber": ["contains currency, percentage, or numeric-heavy content"],
    "ad": ["contains advertising disclosure markers"],
    "buttonLike": ["short action-like text", "compact block bounds"],
    "linkLike": ["short navigational or link-like text"],
    "navigation": ["short text near a navigation edge"],
    "formLabel": ["short label-like text"],
    "inputPlaceholder": ["matches common placeholder wording"],
    "tableHeader": ["short header-like text near upper area"],
    "paragraph": ["long prose-like block"],
    "chatMessage": ["message-length text in conversation-like horizontal bounds"],
    "heading": ["short prominent text", "appears high or early in reading order"],
    "metadata": ["date, time, status, or small descriptive metadata pattern"],
    "tableCell": ["short standalone text without stronger structural signal"],
    "unknown": ["no strong structural rule matched"],
}


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def rules(text: Column, n: Column, c: Column, x: Column, y: Column, w: Column, h: Column, first_text: Column) -> list[tuple[str, float, Column]]:
    """(role, confidence, predicate) in order. text: trimmed; n, c: words and characters of the untrimmed block; x, y, w, h:
    shares of the frame; first_text: of the display's first block."""
    low = F.lower(text)
    has = lambda words, of=low: _any([F.contains(of, F.lit(v)) for v in words])
    begins = lambda words: _any([F.startswith(low, F.lit(v)) for v in words])
    is_one = lambda words: low.isin(words)
    digits = F.length(F.regexp_replace(text, r"[^\p{N}]", ""))
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    digit = digits > 0
    first = F.substring(text, 1, 1)
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return [
        ("empty", 0.2, text == ""),
        ("codeOrLog", 0.78, has(CODE_ANYWHERE) | begins(CODE_PREFIX) | has(CODE_TOKENS, text)),
        ("priceOrNumber", 0.74, digit & (has(PRICE_MARKS, text) | (digits / F.greatest(solid, F.lit(1)) >= 0.55))),
        ("ad", 0.7, is_one(AD_EXACT) | begins(AD_PREFIX) | has(AD_ANYWHERE)),
        ("buttonLike", 0.76, (n <= 5) & (w <= 0.45) & (h <= 0.12) & (is_one(BUTTON_EXACT) | begins(BUTTON_PREFIX))),
        ("linkLike", 0.7, (n <= 7) & (begins(LINK_PREFIX) | has(LINK_ANYWHERE) | is_one(LINK_EXACT))),
        ("navigation", 0.68, (n <= 4) & ((y <= 0.18) | (x <= 0.18) | (x + w >= 0.82)) & is_one(NAVIGATION_EXACT)),
        ("formLabel", 0.72, (n <= 5) & (F.endswith(low, F.lit(":")) | is_one(LABEL_EXACT))),
        ("inputPlaceholder", 0.68, (n <= 8) & (begins(PLACEHOLDER_PREFIX) | has(["placeholder"]))),
        ("tableHeader", 0.64, (n <= 4) & (y <= 0.35) & is_one(TABLE_EXACT)),
        ("paragraph", 0.7, (c >= 90) | (n >= 14)),
        ("chatMessage", 0.62, c.between(12, 280) & has([".", "?", "!"]) & w.between(0.25, 0.85) & (x >= 0.05) & (x + w <= 0.95)),
        ("heading", 0.72, (n <= 10) & (upper | (n <= 3)) & ((y <= 0.28) | (text == first_text))),
        ("metadata", 0.64, (n <= 8) & (has(METADATA_ANYWHERE) | (digit & has([":", "/", "-"])))),
        ("tableCell", 0.48, n <= 8),
    ]


def classify(blocks: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """blocks (doc_id, display_id, block_no, text, x, y, w, h) with role, confidence, reasons. The frame is that of the document."""
    part = lambda v, of: F.when((frame_w > 0) & (frame_h > 0), F.col(v) / of).otherwise(0.0)
    first = F.first(trimmed("text")).over(Window.partitionBy("doc_id", "display_id").orderBy("block_no"))
    rows = blocks.withColumns({"_first": first, "_text": trimmed("text"), "_n": word_count("text"), "_c": F.length("text"), "_x": part("x", frame_w), "_y": part("y", frame_h), "_w": part("w", frame_w), "_h": part("h", frame_h)})
    found = rules(*(F.col(c) for c in ("_text", "_n", "_c", "_x", "_y", "_w", "_h", "_first")))
    result = lambda name, conf: F.struct(F.lit("unknown" if name == "empty" else name).alias("role"), F.lit(max(0.0, min(1.0, conf))).alias("confidence"), F.array(*map(F.lit, REASONS[name])).alias("reasons"))
    chain = None
    for name, conf, test in found:
        chain = F.when(test, result(name, conf)) if chain is None else chain.when(test, result(name, conf))
    return rows.withColumn("_r", chain.otherwise(result("unknown", 0.4))).select(*blocks.columns, "_r.*")
