"""Op 9: personal data by anchor expansion.

An Aho-Corasick automaton runs over the text once and reports anchors:
at-signs, plus signs, digits, schemes (``://``) and identifier cues (words
such as "iban" or "passport").  Each anchor is expanded by a deterministic
local parser to the boundaries of an e-mail address, an IP address, a card or
phone number, a URL that carries user data, or an account identifier, and
validated.  Per kind, spans never overlap and the leftmost wins.

Base kinds are email, ip, card and phone; url (with user name or e-mail
address in it) and account (a cue followed by an identifier, or a valid IBAN
after its cue) are added.  Positions are code points, end exclusive.

Edge cases: null texts count as empty (no spans, digest of the empty string);
whole texts are scanned whatever their length; repeated rows are scanned each;
no shuffle, so hot sources do not matter.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactlake.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}
CUES = ("iban", "account", "acct", "passport", "ssn", "customer id", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'|]+")
_SCHEME = re.compile(r"(?:https?|ftp|sftp|ssh|postgres|mysql|mongodb|redis|amqp)\Z", re.I | re.A)
#: An identifier has 34 letters and digits at most (the longest IBAN); a longer
#: one is read just far enough to be refused.
_IBAN_HEAD = re.compile(r"[A-Za-z]{2} ?[0-9] ?[0-9]")
_ACCOUNT = re.compile(r"(?:[ \t]*+(?:no|nr|number|id))?[ \t]*+[.:#=]{0,2}+[ \t]*+([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){0,40})", re.I | re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()
            and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1)


class Scanner:
    def __init__(self):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for word, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"),
                           *((str(d), "digit") for d in range(10)),
                           *((v, "cue") for c in CUES for v in {c, c.upper(), c.title(), c.capitalize()})]:
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end), sorted by start and then by kind."""
        found: list[tuple[int, str, int]] = []
        done = dict.fromkeys((*KINDS, "plain"), 0)
        for end, (anchor, size) in self.automaton.iter(text):
            at = end - size + 1
            if anchor == "digit":
                if at >= done["card"]:
                    self._card(text, at, done, found)
                if at >= done["ip"]:
                    self._ip(text, at, done, found)
            elif anchor == "at":
                self._email(text, at, done, found)
            elif anchor == "plus":
                if at >= done["phone"]:
                    self._phone(text, at, done, found)
            elif anchor == "scheme":
                self._url(text, at, done, found)
            elif at >= done["account"]:
                self._account(text, at, end + 1, done, found)
        found.sort(key=lambda s: (s[0], ORDER[s[1]]))
        return found

    def _email(self, text, at, done, found):
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            found.append((start, "email", host.end()))
            done["email"] = host.end()

    def _ip(self, text, at, done, found):
        m = _IP.match(text, at)
        if not m:               # the rest of this run of digits cannot start one either
            done["ip"] = _DIGITS.match(text, at).end()
            return
        done["ip"] = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((at, "ip", m.end()))

    def _card(self, text, at, done, found):
        m = _CARD.match(text, at)
        if not m:
            return
        done["card"] = m.end()
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((at, "card", m.end()))

    def _phone(self, text, at, done, found):
        m = _PHONE.match(text, at)
        if not m:
            return
        done["phone"] = m.end()
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            found.append((at, "phone", m.end()))

    def _url(self, text, at, done, found):
        if at < done["plain"]:              # inside a run of characters without an at-sign
            return
        start = at
        while start > max(done["url"], at - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        rest = _URL_REST.match(text, at + 3) if _SCHEME.match(text[start:at]) else None
        if not rest:
            return
        end = at + 3 + len(rest.group().rstrip(".,;:!?)]}"))
        if "@" in text[at + 3:end]:
            found.append((start, "url", end))
            done["url"] = end
        else:
            done["plain"] = rest.end()

    def _account(self, text, at, after, done, found):
        if at and text[at - 1].isalnum():
            return
        m = _ACCOUNT.match(text, after)
        if not m:
            return
        # the identifier: the longest valid IBAN, else the first unbroken word with five digits or more
        first = m.group(1).partition(" ")[0]
        end = m.end(1) if _IBAN_HEAD.match(text, m.start(1)) else 0
        while end and not ((end == m.end(1) or text[end] == " ") and iban_ok(text[m.start(1):end])):
            end = max(text.rfind(" ", m.start(1) + 14, end), 0)
        if not end and len(first) <= 34 and sum(map(first.count, "0123456789")) >= 5:
            end = m.start(1) + len(first)
        if end:
            found.append((m.start(1), "account", end))
            done["account"] = end


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with an array of (start, end, kind) in ``spans_col`` (a column
    of that name is replaced)."""
    kept = [f for f in docs.schema.fields if f.name != spans_col]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("kind", T.StringType())])
    schema = T.StructType([*kept, T.StructField(spans_col, T.ArrayType(span))])

    def run(batches):
        import pyarrow as pa
        scanner = Scanner()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for whole in batches:
            for batch in common.by_bytes(whole, text_col):
                cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                spans = pa.array([[{"start": s, "end": e, "kind": k} for s, k, e in scanner.spans(t or "")]
                                  for t in texts], kind)
                yield pa.RecordBatch.from_arrays([*cols, spans], names=[f.name for f in kept] + [spans_col])

    return docs.mapInArrow(run, schema)


DIGEST = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_url long, n_account long")


def span_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    def run(batches):
        import pyarrow as pa
        scanner = Scanner()
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                counts, sha, lists = {k: [] for k in KINDS}, [], []
                for text in batch.column(1).to_pylist():
                    spans = scanner.spans(text)
                    kinds = [k for _, k, _ in spans]
                    for k in KINDS:
                        counts[k].append(kinds.count(k))
                    base = joined(s for s in spans if s[1] in BASE_KINDS)
                    sha.append(hashlib.sha256(base.encode()).hexdigest())
                    lists.append(joined(spans))
                n = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(n[k] for k in BASE_KINDS), pa.array(sha, pa.string()), pa.array(lists, pa.string()),
                     n["url"], n["account"]],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_url", "n_account"])

    return common.documents_of(docs).mapInArrow(run, DIGEST)
