"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, URL schemes,
identifier cues and the prefixes of known keys in one pass over a text. A local parser of each kind expands an
anchor to its boundaries and validates what it finds. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from docquery.llm.common import slices

#: In the order of the results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = frozenset(KINDS[:4])
#: What announces an identifier.
CUES = ("iban", "account", "acct", "ssn", "passport", "token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key")
#: How keys of well-known services begin, and how many characters must follow at least.
KEY_PREFIXES = (
    ("AKIA", 16), ("ASIA", 16), ("ghp_", 30), ("gho_", 30), ("ghu_", 30), ("ghs_", 30), ("ghr_", 30), ("github_pat_", 30), ("glpat-", 18), ("xoxb-", 20), ("xoxp-", 20),
    ("xoxa-", 20), ("sk_live_", 16), ("rk_live_", 16), ("AIza", 30), ("npm_", 30), ("eyJ", 30),
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`{}|\\^]*")
_KEY_REST = re.compile(r"[A-Za-z0-9_.-]*[A-Za-z0-9_-]")
_IBAN = re.compile(r"\W{0,3}(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_VALUE = re.compile(r"(?i:[ _-](?:no\.?|number|id|key))?[ \t]{0,3}(?:[:=#]|(?i:is) )[ \t]{0,3}[\"']?(?P<v>[A-Za-z0-9][A-Za-z0-9_/+=.-]{4,}[A-Za-z0-9=])(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?i:[ _-](?:no\.?|number|id))?[ \t]{1,3}(?P<v>[0-9](?:[ -]?[0-9]){5,})(?![A-Za-z0-9])")
_AFTER_URL = ".,;:!?)]"

FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
FOUND_SQL = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s in ("@", "+", "://", *"0123456789"):
        a.add_word(s, (s if not s.isdigit() else "0", len(s)))
    for cue in CUES:
        for form in product(*({c, c.upper()} for c in cue)):  # at most 512 a cue
            a.add_word("".join(form), ("cue", len(form)))
    for prefix, least in KEY_PREFIXES:
        a.add_word(prefix, (f"key{least}", len(prefix)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, less 9 if above 9."""
    doubled = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in s) <= 15


def _is_iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _left(text: str, at: int, low: int, allowed: frozenset) -> int:
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then by start.

    Within a kind, matches are the leftmost ones that don't overlap; a match
    that fails its validation still uses up its text.
    """
    if not text:
        return []
    end = dict.fromkeys(KINDS, 0)
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}

    def take(kind: str, start: int, stop: int, valid: bool) -> None:
        end[kind] = stop
        if valid:
            found[kind].append((kind, start, stop))

    for last, (what, length) in _automaton().iter(text):
        at = last - length + 1
        if what == "0":
            if at and "0" <= text[at - 1] <= "9":
                continue  # inside a run: its start has been tried
            if at >= end["account"] + 2 and text[at - 2 : at].isupper() and text[at - 2 : at].isascii() and not (at > 2 and text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and _is_iban(m["v"]):
                take("account", m.start("v"), m.end("v"), True)
            if at >= end["ip"] and (m := _IP.match(text, at)):
                take("ip", at, m.end(), _is_ip(m[0]))
            if at >= end["card"] and (m := _CARD.match(text, at)):
                take("card", at, m.end(), _is_card(m[0]))
        elif what == "@":
            start = _left(text, at, end["email"], _LOCAL)
            if start < at and at >= end["email"] and (m := _DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif what == "+":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                take("phone", at, m.end(), _is_phone(m[0]))
        elif what == "://":
            start = _left(text, at, max(end["url"], at - 32), _SCHEME)
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := _URL_REST.match(text, at + 3)):
                stop = at + 3 + len(m[0].rstrip(_AFTER_URL))
                take("url", start, stop, stop > at + 3)
        elif what[:3] == "key":
            if at >= end["account"] and not (at and text[at - 1].isalnum()) and (m := _KEY_REST.match(text, last + 1)) and len(m[0]) >= int(what[3:]):
                take("account", at, m.end(), True)
        elif at >= end["account"] and not (at and text[at - 1].isalnum()):
            if (m := _IBAN.match(text, last + 1)) and _is_iban(m["v"]):
                take("account", m.start("v"), m.end("v"), True)
            elif m := _VALUE.match(text, last + 1):
                take("account", m.start("v"), m.end("v"), any(c.isdigit() for c in m["v"]))
            elif m := _NUMBER.match(text, last + 1):
                take("account", m.start("v"), m.end("v"), True)
    return [s for k in KINDS for s in found[k]]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Puts `[kind]` in the place of every span; of spans that overlap, the
    whole stretch gets the kind of the first."""
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return text if not out else "".join(out) + text[at:]


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "found") -> DataFrame:
    """(id, found) for every row of docs; found: array of (kind, start, end,
    value), by kind as listed in KINDS, then by start.

    Only the two columns are read, so others may have any name. A null or empty
    text gives an empty array; a null id stays null; repeated rows are searched
    one by one; an empty table gives an empty result. Texts are searched whole.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.columns
            rows = [
                [{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find_spans(t)] for t in texts.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, FOUND)], [id_col, into])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(search, f"`{id_col}` {kind}, `{into}` {FOUND_SQL}")


def redact_private(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with `[kind]` for everything found in text_col; length_col, if
    named, gets the new length in code points. All other columns, whatever
    their names, and the number of rows stay; null texts stay null."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length_col:
                k = batch.schema.get_field_index(length_col)
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in new], batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(clean, docs.schema)
