"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From
each anchor a local parser expands to the boundaries of an e-mail address, a network or web address, or a card, phone or
account number and validates it. The parsers reproduce leftmost, non-overlapping matching of each kind: a parser starts
no further left than the end of the last match of its kind, whether that match was valid or not.

Kinds: email, ip, card and phone, then account (a number after a cue such as ``account`` or ``IBAN``, holding a digit
and six characters at least, or a whole IBAN with right check digits), url (a scheme, ``://`` and what follows up to
a blank, quote or bracket) and secret (what is assigned to a cue such as ``token`` or ``password``, of eight characters at
least with a digit among them; tokens of known forms; private keys from their first line to their last, or the first line
alone where there is no last one). No value has a greatest length. Positions count code points; ends are exclusive.

Edge cases: a null or empty text has no spans. Repeated rows are searched one by one. Other columns pass through. Work is
linear in a text's length: where a run of characters ends is remembered for the anchors that lie within it.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import col, free_name, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url", "secret")
CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "user id", "tax id")
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "credential", "bearer")
#: How tokens of known issuers and encodings begin, and their forms.
TOKENS = {
    "akia": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ghp_": r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{40,}",
    "glpat-": r"glpat-[0-9A-Za-z_-]{20,}",
    "xox": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "sk-": r"sk-[0-9A-Za-z_-]{20,}",
    "eyj": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "-----begin": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]*?-----END [A-Z0-9 ]*PRIVATE KEY-----)?",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?:[\x20]?(?:no|number|nr)\.?)?[\x20:=#\"']{1,3}([A-Za-z0-9](?:[A-Za-z0-9-]|[\x20](?=[0-9]))*+)", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[\"']?[\x20]{0,2}(?:=>|:=|[=:])[\x20]{0,2}[\"']?(?=[A-Za-z0-9+/=_.~$!@#%^&*-])")
_BORNE = re.compile(r"[\x20]+(?=[A-Za-z0-9+/=_.~-])")
_TOKENS = {start: re.compile(form) for start, form in TOKENS.items()}
_KEY_BEGINS, _KEY_ENDS = (re.compile(rf"-----{x} [A-Z0-9 ]*PRIVATE KEY-----") for x in ("BEGIN", "END"))
_WEB = re.compile(r"[^\s\"'<>()\[\]{}]+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

Span = tuple[int, int]


class _Run:
    """Where the run of some characters ends that a place lies in; each run of a text is looked at once."""

    def __init__(self, text: str, characters: str):
        self.text, self.all_of = text, re.compile(f"[{characters}]*+")
        self.start = self.stop = 0

    def end(self, at: int) -> int:
        if not self.start <= at < self.stop:
            self.start, self.stop = at, self.all_of.match(self.text, at).end()
        return self.stop


class _Values(_Run):
    """Runs as values: without marks at their ends, and with the place of their last digit."""

    def __init__(self, text: str, characters: str):
        super().__init__(text, characters)
        self.known, self.stripped, self.digit = -1, 0, -1

    def value(self, at: int) -> tuple[int, bool]:
        """(end, whether a digit is among it) of the value from a place on."""
        stop = self.end(at)
        if self.known != stop:
            self.known, self.stripped = stop, stop
            while self.stripped > self.start and self.text[self.stripped - 1] in ".,;:!?":
                self.stripped -= 1
            self.digit = max(self.text.rfind(d, self.start, self.stripped) for d in _DIGITS)
        return self.stripped, self.digit >= at


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *_DIGITS):
        found.add_word(word, (word if word in ("@", "+", "://") else "0", len(word)))
    for kind, cues in (("cue", CUES), ("secret", SECRET_CUES), ("token", TOKENS)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """A to Z in lower case, so that cues are found in every spelling; places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


class Parser:
    """Anchors of one text in, spans out."""

    def __init__(self, text: str):
        self.text, self.spans = text, {k: [] for k in KINDS}
        self.ends = dict.fromkeys(KINDS, 0)
        self.run_end = 0
        self.assigned, self.borne = _Values(text, "A-Za-z0-9+/=_.~$!@#%^&*-"), _Values(text, "A-Za-z0-9+/=_.~-")
        # the parts of a token in three, and what may stand between the lines of a key
        (self.first, self.second, self.third), self.between = (_Run(text, "0-9A-Za-z_-") for _ in range(3)), _Run(text, r"A-Za-z0-9+/=:,\s-")
        self.key_end: tuple[int, int, int] | None = None

    def keep(self, kind: str, start: int, end: int, valid: bool = True) -> None:
        self.ends[kind] = end
        if valid:
            self.spans[kind].append((start, end))

    def email(self, at: int) -> None:
        domain = _DOMAIN.match(self.text, at + 1)
        start, least = at, self.ends["email"]
        if domain:
            while start > least and self.text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                self.keep("email", start, domain.end())

    def number(self, at: int) -> None:
        """At the first digit of a run."""
        text = self.text
        self.run_end = _RUN.match(text, at).end()
        if at >= self.ends["ip"] and (m := _IP.match(text, at)):
            self.keep("ip", at, m.end(), all(map(in_byte, m[0].split("."))))
        if at >= self.ends["card"] and (m := _CARD.match(text, at)):
            digits = m[0].replace(" ", "").replace("-", "")
            self.keep("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        if at >= 2 and at >= self.ends["account"] + 2 and text[at - 1].isalpha() and (at < 3 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and iban(m[0]):
            self.keep("account", at - 2, m.end())

    def phone(self, at: int) -> None:
        if at >= self.ends["phone"] and (m := _PHONE.match(self.text, at)):
            self.keep("phone", at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)

    def account(self, start: int, end: int) -> None:
        """After a cue."""
        if start and self.text[start - 1].isalnum():
            return
        if start >= self.ends["account"] and (m := _NUMBER.match(self.text, end)):
            number = m[1].rstrip("-")
            if len(number) >= 6 and any(c in _DIGITS for c in number):
                self.keep("account", m.start(1), m.start(1) + len(number))

    def secret(self, start: int, end: int) -> None:
        """What is assigned to a cue, or follows it where it says who bears it."""
        if start < self.ends["secret"] or (start and self.text[start - 1].isalnum()):
            return
        for lead, values in ((_ASSIGNED, self.assigned), (_BORNE, self.borne)):
            if (lead is _ASSIGNED or folded(self.text[start:end]) == "bearer") and (m := lead.match(self.text, end)):
                if values.end(m.end()) - m.end() < 8:
                    continue
                stop, digit = values.value(m.end())
                if stop - m.end() >= 8 and digit:
                    self.keep("secret", m.end(), stop)
                return

    def token(self, start: int, end: int) -> None:
        """A secret known by its form alone."""
        if start < self.ends["secret"] or (start and self.text[start - 1].isalnum()):
            return
        cue = folded(self.text[start:end])
        stop = self.three_parts(start) if cue == "eyj" else self.key(start) if cue == "-----begin" else (m := _TOKENS[cue].match(self.text, start)) and m.end()
        if stop:
            self.keep("secret", start, stop)

    def three_parts(self, start: int) -> int | None:
        """The end of a token of three parts of eight characters at least, of which the first begins with eyJ."""
        text = self.text
        if not text.startswith("eyJ", start):
            return None
        one = self.first.end(start)
        if one - start < 11 or not text.startswith(".", one):
            return None
        two = self.second.end(one + 1)
        if two - one < 9 or not text.startswith(".", two):
            return None
        three = self.third.end(two + 1)
        return three if three - two >= 9 else None

    def key(self, start: int) -> int | None:
        """The end of a private key's last line, if nothing but a key's characters stands before it; else of its first line."""
        if not (m := _KEY_BEGINS.match(self.text, start)):
            return None
        if self.key_end is None or not self.key_end[0] <= m.end() <= self.key_end[1]:
            found = _KEY_ENDS.search(self.text, m.end())
            self.key_end = (m.end(), found.start(), found.end()) if found else (m.end(), len(self.text) + 1, 0)
        _, last, stop = self.key_end
        return stop if stop and self.between.end(m.end()) >= last else m.end()

    def url(self, at: int) -> None:
        start, least = at, self.ends["url"]
        while start > least and self.text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not self.text[start].isalpha():
            start += 1
        if start < at and (m := _WEB.match(self.text, at + 3)):
            self.keep("url", start, at + 3 + len(m[0].rstrip(".,;:!?")))


def spans_of(text: str, found: ahocorasick.Automaton) -> dict[str, list[Span]]:
    parser = Parser(text)
    for last, (kind, length) in found.iter(folded(text)):
        if kind == "0":
            if last >= parser.run_end:
                parser.number(last)
        elif kind == "@":
            parser.email(last)
        elif kind == "+":
            parser.phone(last)
        elif kind == "cue":
            parser.account(last - length + 1, last + 1)
        elif kind == "secret":
            parser.secret(last - length + 1, last + 1)
        elif kind == "token":
            parser.token(last - length + 1, last + 1)
        else:
            parser.url(last - 2)
    return parser.spans


def listed(spans: dict[str, list[Span]], kinds) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in sorted(spans[kind]))


_FOUND = ", ".join(f"n_{k}:bigint" for k in KINDS)
_TYPE = f"struct<{_FOUND}, base_sha256:string, spans:string>"


def find(text: Column) -> Column:
    """A struct: counts by kind, a hash of the base spans, and all spans as kind:start:end."""
    cache: list[ahocorasick.Automaton] = []

    def search(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(anchors())
        rows = [spans_of(x or "", cache[0]) for x in texts.to_pylist()]
        counts = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS]
        base = pa.array([hashlib.sha256(listed(r, BASE_KINDS).encode()).hexdigest() for r in rows], pa.string())
        return pa.StructArray.from_arrays([*counts, base, pa.array([listed(r, KINDS) for r in rows], pa.string())], [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return F.arrow_udf(search, _TYPE)(text.cast("string"))


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind; where spans overlap, by the kind of the one that starts first."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k in KINDS for s, e in spans[k]):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = -end
        elif -end > at:
            at = -end
    return "".join([*out, text[at:]])


def mask(text: Column) -> Column:
    cache: list[ahocorasick.Automaton] = []

    def replace(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(anchors())
        return pa.array([None if x is None else masked(x, spans_of(x, cache[0])) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(replace, "string")(text.cast("string"))


def annotate(docs: DataFrame, into: str, *, text_col: str = "text") -> DataFrame:
    """The documents with a struct column ``into`` of what was found."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, find(col(text_col)))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with personal data in the text replaced by its kind."""
    small_batches(docs.sparkSession)
    into = free_name(docs, "masked")
    return docs.withColumn(into, mask(col(text_col))).withColumn(text_col, col(into)).drop(into)
