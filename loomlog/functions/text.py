"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, secret patterns (before, secret, after, label) in order, terminal noise.
SPACE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"
SECRETS = [
    (r"()(AKIA[0-9A-Z]{16})()", "AWS_KEY"),
    (r"(?i)((?:aws_secret_access_key|aws_secret)\s*[=:]\s*[\"']?)([A-Za-z0-9/+=]{40})()", "AWS_SECRET"),
    (r"()(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)()", "JWT"),
    (r"()([sp]k_(?:live|test)_[a-zA-Z0-9]{24,})()", "STRIPE"),
    (r"(?i)((?:api[_-]?key|token|client_secret)\s*[=:]\s*[\"']?)([a-zA-Z0-9]{32,})()", "API_KEY"),
    (r"(://[^:]+:)([^@\s]+)(@)", "PASSWORD"),
    (r"(?i)((?:password|passwd|pwd)\s*[=:]\s*[\"']?)(\S+)()", "PASSWORD"),
]
NOISE_CHARACTERS = r"[\x{2500}-\x{259F}\x{2800}-\x{28FF}\x{2700}-\x{27BF}\x{00B7}\x{276F}\x{27E8}\x{27E9}\x{29C9}\x{23B0}-\x{23FF}\x{2190}-\x{21FF}\x{2B50}-\x{2B5F}\x{23F5}\x{279C}]+"
NOISE_PHRASES = [
    r"accept\s*edits?\s*on", r"shift\+tab\s*to\s*cycle", r"Esc\s*to\s*cancel", r"Tab\s*to\s*amend", r"ctrl\+[a-z]\s*to\s*\w+",
    r"Do\s*you\s*want\s*to\s*proceed\??", r"Yes,?\s*and\s*always\s*allow", r"for\s*bash\s*mode", r"to\s*go\s*back",
    r"Esc/Enter/Space\s*to\s*close", r"k\s*to\s*kill", r"\w+ing…\s*\([^)]*tokens?\)", r"\w+ing…", r"Running…", r"Reading\s*\d+\s*files?…",
    r"Loading\s*output…", r"thought\s*for\s*\d+s", r"\d+[ms]\s+[\d.]+[km]?\s*tokens?", r"\d+\s*files?\s*\+\d+\s*-\d+", r"\w+\s*git:\([^)]*\)",
    r"\d+\s*bash\b", r"Shell\s*details", r"Status:\s*running", r"Runtime:\s*\d+[ms]\s*\d*[ms]?",
]


#: The characters that SPACE matches.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def quality_score(text: Column) -> Column:
    """Letters and digits as a part of the stripped text, to three places, ties to even; 0 for a blank text."""
    s = strip(text)
    n = F.length(s)
    return F.when(n > 0, F.bround(F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")) / n, 3)).otherwise(0.0)


def budget_tokens(text: Column) -> Column:
    return (F.length(text) / 4 * 1.1).cast("int")


def chunk_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def decay_factor(ts: Column, half_life_days: float, now: float) -> Column:
    age = (F.lit(float(now)) - ts) / 86400.0
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.when(age <= 0, 1.0).otherwise(F.exp(-age * 0.6931471805599453 / half_life_days))


def boosted(score: Column, artifact_type: Column, ts: Column, half_life_days: float, now: float) -> Column:
    return F.when(artifact_type.isNull(), score * (1 + 0.1 * decay_factor(ts, half_life_days, now))).otherwise(score)


def event_id(session_id: Column, ts_text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", session_id, ts_text), 256), 1, 16)


def parse_timestamp(iso: Column) -> Column:
    return F.coalesce(F.unix_micros(F.try_to_timestamp(iso)) / 1e6, F.lit(0.0))


def redact(text: Column, extra: Sequence[tuple[str, str]] = ()) -> Column:
    """Secrets replaced by [REDACTED:LABEL]; extra patterns replace their first group, or their whole match without one."""
    for pattern, label in SECRETS:
        text = F.regexp_replace(text, "(?U)" + pattern, f"$1[REDACTED:{label}]$3")
    for pattern, label in extra:
        flags, body = re.match(r"((?:\(\?[a-zA-Z]+\))*)(.*)", pattern, re.S).groups()
        shaped, kept = _around_first_group(body)
        text = F.regexp_replace(text, "(?U)" + flags + shaped, f"$1[REDACTED:{label}]${kept}")
    return text


def _around_first_group(pattern: str) -> tuple[str, int]:
    """The pattern with groups around what comes before its first capturing group and after it, and the number of the latter; the whole
    match is the secret if there is none. Brackets that are escaped, in a class or don't capture are no groups."""
    at, open_, depth, groups, in_class = 0, None, 0, 0, False
    close, stack = None, []
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            at += pattern[at + 1 : at + 2] == "^"
            at += pattern[at + 1 : at + 2] == "]"
        elif c == "(":
            captures = pattern[at + 1 : at + 2] != "?" or bool(re.match(r"\?P?<[A-Za-z]", pattern[at + 1 :]))
            if captures and open_ is None and not stack:
                open_ = at
                stack.append("first")
            else:
                stack.append("other")
            groups += captures and close is None
        elif c == ")" and stack and stack.pop() == "first":
            close = at
        at += 1
    if open_ is None:
        return f"()({pattern})()", 3
    return f"({pattern[:open_]}){pattern[open_ : close + 1]}({pattern[close + 1 :]})", groups + 2


def strip_noise(text: Column) -> Column:
    text = F.regexp_replace(text, NOISE_CHARACTERS, "")
    text = F.regexp_replace(text, "(?iU)(?:" + "|".join(NOISE_PHRASES) + ")", "")
    text = F.regexp_replace(text, r"(?U)[^\S\n]{3,}", " ")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalised(text: Column) -> Column:
    """The key of exact duplicates: lower case, white space runs as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(text), rf"{SPACE}+", " "))


def project_key(path: Column) -> Column:
    return F.concat(F.lit("-"), F.translate(F.regexp_replace(path, r"^/+|/+$", ""), "/_", "--"))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
