"""Credentials in source code: found by one automaton, located exactly, and replaced in place.

Token formats, key armor and the grammars of addresses, connection strings and settings are compiled into one
deterministic automaton.  Its search part (Aho-Corasick over the words that can start a credential) reads a text once, in
chunks that overlap by the longest word, so that no word is lost at a border; hits of overlapping chunks are deduplicated
by absolute position.  Each word leads to an entry of the table part (``automaton``), which reads on over the whole text,
so that a value is never cut by a chunk.  What a value is worth is judged after its place is known.  Spans are
deduplicated, overlaps resolved in favour of the first and longer one, and placeholders spliced in, which leaves all other
characters as they were.  Each part of a text is read a bounded number of times, whatever stands in it.

Defined results: null and empty texts have no span and come out as they are; positions are 1-based code points; a value
that occurs twice is two spans; a repeated row has its own spans.  A placeholder is as many stars as the value had
characters: positions and lines stay, but a field of a number or of base64 is no longer one.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.automaton import Automaton
from threshline.llm.batches import slices

CHUNK = 1 << 16

#: Public formats of tokens, by the word that starts them.
TOKENS = {
    "akia": r"AKIA[A-Z0-9]{16}", "asia": r"ASIA[A-Z0-9]{16}", "abia": r"ABIA[A-Z0-9]{16}", "acca": r"ACCA[A-Z0-9]{16}",
    "ghp_": r"ghp_[A-Za-z0-9]{36}", "gho_": r"gho_[A-Za-z0-9]{36}", "ghu_": r"ghu_[A-Za-z0-9]{36}", "ghs_": r"ghs_[A-Za-z0-9]{36}", "ghr_": r"ghr_[A-Za-z0-9]{36}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{40,}", "glpat-": r"glpat-[A-Za-z0-9_\-]{20,}", "glrt-": r"glrt-[A-Za-z0-9_\-]{20,}", "gldt-": r"gldt-[A-Za-z0-9_\-]{20,}", "glptt-": r"glptt-[A-Za-z0-9]{40}",
    "xoxb-": r"xoxb-[0-9A-Za-z\-]{20,}", "xoxp-": r"xoxp-[0-9A-Za-z\-]{20,}", "xoxa-": r"xoxa-[0-9A-Za-z\-]{20,}", "xoxr-": r"xoxr-[0-9A-Za-z\-]{20,}", "xoxs-": r"xoxs-[0-9A-Za-z\-]{20,}", "xapp-": r"xapp-[0-9A-Za-z\-]{20,}",
    "hooks.slack.com/services/": r"hooks.slack.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]{20,}", "discord.com/api/webhooks/": r"discord.com/api/webhooks/[0-9]+/[A-Za-z0-9_\-]{40,}",
    "sk-": r"sk-(proj-|ant-|live-|test-)?[A-Za-z0-9_\-]{20,}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}", "sk_test_": r"sk_test_[A-Za-z0-9]{16,}", "rk_live_": r"rk_live_[A-Za-z0-9]{16,}", "whsec_": r"whsec_[A-Za-z0-9]{24,}",
    "sg.": r"SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}", "key-": r"key-[0-9a-f]{32}", "aiza": r"AIza[A-Za-z0-9_\-]{35}", "gocspx-": r"GOCSPX-[A-Za-z0-9_\-]{28}", "ya29.": r"ya29\.[A-Za-z0-9_\-]{30,}",
    "npm_": r"npm_[A-Za-z0-9]{36}", "pypi-": r"pypi-[A-Za-z0-9_\-]{40,}", "dckr_pat_": r"dckr_pat_[A-Za-z0-9_\-]{27}", "dop_v1_": r"dop_v1_[0-9a-f]{64}", "shpat_": r"shpat_[0-9a-fA-F]{32}", "dapi": r"dapi[0-9a-f]{32}",
    "hf_": r"hf_[A-Za-z]{34}", "hvs.": r"hvs\.[A-Za-z0-9_\-]{24,}", "glsa_": r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}", "nrak-": r"NRAK-[A-Z0-9]{27}", "sq0atp-": r"sq0atp-[A-Za-z0-9_\-]{22}", "eyj": r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}
#: Keys that name their stage: a short name, the stage, and a random part.  A published key is no secret.
STAGES = ("_live_", "_prod_", "_production_", "_stage_", "_staging_", "_test_", "_dev_", "_sandbox_")
#: What the table part reads, beside the tokens.  Values are read from where one of these ends.
GRAMMARS = {
    "staged": "[a-z]{2,10}(" + "|".join(STAGES) + ")[A-Za-z0-9]{20,}",
    # A body holds no second head: there the table has no way on, so heads without an end are read once.
    "armor": r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----([^\-]|-{1,4}[^\-]|------*[^\-BE])*-*-----END ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----",
    # What stands before the host of an address: user and password.
    "user": r"""://[^\s/:@'"`<>]*:""",
    "until host": r"""[^\s/'"`<>@]+@([^\s/'"`<>@]*@)*""",
    # Between a name and its value: quotes or brackets that close the name, then an assignment or separator.
    "link": r"""(\\?["'`])?\]?[ \t]*(:=|=>|[=:,>|])[ \t]*""",
    "typed": r"""[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\]?]*[ \t]*=[ \t]*""",
    "xml": r"""\\?["']\s+[vV][aA][lL][uU][eE]\s*=\s*""",
    "nested": r"""\{"[\w.\-]+"\s*:\s*""",
    # The end of a header's name, its sign and the scheme.
    "header": r"""(\\?["'`])?\s*[:=,]\s*(\\?["'`])?(([bB][eE][aA][rR][eE][rR]|[bB][aA][sS][iI][cC]|[tT][oO][kK][eE][nN])\s+)?""",
    "bare": r"""[^\s"'`,;<>|(){}\[\]][^\s"'`;<>|]*""",
    "pair": r"""\{?[^;"'`\s]+""",
    # A line of a password file of a database: host, then port, database and user, then the password.
    "ported": r":[0-9]{2,5}:[\w*.\-]+:[\w*.@\-]+:",
    "word": r"""[^\s"'`,;<>|\\]+""",
}
PORTED_HOST, PORTED_VALUE = re.compile(r"[+\- ]?\s*[\w.*-]+"), re.compile(r"((?:\\.|[^\s\\:\"'`])+)[ \t]*\r?(?=\n|\Z)")
HOST = re.compile(r"[\w\[.-]")
#: Words that name a secret when a setting name ends in them, alone or as the last part of a name.
NAMES = (
    "password", "passwort", "passwd", "pwd", "passphrase", "passcode", "pass", "pw", "secret", "token", "apikey", "api_key", "api-key",
    "secretkey", "secret_key", "secret-key", "accesskey", "access_key", "access-key", "accesskeyid", "access_key_id", "privatekey", "private_key", "private-key",
    "licensekey", "license_key", "signingkey", "signing_key", "signing-key", "encryptionkey", "encryption_key", "masterkey", "master_key",
    "authkey", "auth_key", "accountkey", "account_key", "sharedkey", "shared_key", "openai_key", "x_auth", "x-auth", "credential", "credentials", "connkey", "webhook_key",
)
#: Commands that take a name and a value without a sign between.
COMMAND = re.compile(r"(?:^|[\n+\- ])(?:ENV|ARG|setenv|setx|SETX|set)[ \t]+\w*\Z")
QUOTED = re.compile(r"""\\?(["'`])((?:(?!\\?\1)[^\r\n])*)\\?\1""")
#: A login told in a sentence: the words, the user, a sign between, the password.
LOGIN_WORDS = ("login is ", "login: ", "log in as ", "credentials are ", "creds are ", "creds: ")
#: Words that are followed by the password itself, in a sentence or a statement.
TELLING = ("identified by ", "temporary password ", "temp password ", "initial password ", ", pw ", ", password ", "パスワードは", "パスワード:", "パスワード：", "密码是", "密码:", "密码：", "비밀번호는", "비밀번호:")
TOLD = re.compile(r"\s{0,2}(?:password\s+)?[\"'`「]?([^\s\"'`,;<>「」、。]+)", re.I)
LOGIN = re.compile(r"[\w.@-]+\s?[/:|,]\s?(\S+)")
#: User and password of a command line option, and of a login file.
OPTION_WORDS = (" -u ", " --user ", " -u=", " --user=", "login ")
OPTION = re.compile(r"[\"']?[\w.@%-]+:([^\s\"'`@/]+)[\"']?(?=\s|$)")
LOGIN_FILE = re.compile(r"\S+\s+password\s+(\S+)")
SCHEME = re.compile(r"(bearer|basic)\s+([A-Za-z0-9+/=._~-]{12,})", re.I)
#: What stands in a value's place but is none.
PLACEHOLDER = re.compile(
    r"""(?ix) ^(?: [x*.•#_-]{3,} | null | none | nil | undefined | true | false | redacted | removed | hidden | masked | dummy | example | sample | todo | tbd | fixme | n/a
      | change[-_]?(?:me|it) | placeholder | secret | password | passwort | token | string | str | test | foo | bar | empty | unset | default | required | optional )$
      | ^(?:your|my|insert|enter|put|replace|add|set|use|some|the|fake|dummy|example|sample)[-_ .] | ^your | [-_ ]here$ | ^<.*>$ | ^\[.*\]$ | ^\{.*\}$ | ^% | ^\$ | \$\{|\$\(|\{\{ | ^@ | ^\#\{ | ^!\w+ | EXAMPLE(?:KEY)?$"""
)
REFERENCE = re.compile(r"""(?ix) ^(?: env | vault | ssm | file | secret | secrets | secretsmanager | keyvault | kms | config | arn | op | gcp | aws | azure | k8s | ref | doppler | https? | ftp | s3 | gs ) : | ^(?:\.{0,2}|~)/ | ^/(?:run|etc|var|home|mnt|opt|usr)/ | ^(?:process\.env|os\.environ|os\.getenv|system\.getenv|environment\.|config\.|settings\.|self\.|this\.|secrets\.|var\.|local\.|data\.|module\.)""")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z_$]*(?:\.[A-Za-z_$]\w*)*")
HEXHASH = re.compile(r"(?:sha\d*|md5)[-:]")
WORDY = re.compile(r"[a-z]+(?:[-_ ][a-z]+)*", re.I)
SETTING = re.compile(r"[a-z][a-z_]*=")
GROUPED = re.compile(r"[A-Z0-9]{4,6}(?:-[A-Z0-9]{4,6}){2,}")
CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,})(?:[A-Z][a-z]+)*")
#: Words and acronyms in mixed case, as names in code and labels are made of.
MIXED_WORDS = re.compile(r"[a-z]?(?:[A-Z]+(?=[A-Z][a-z]|\Z)|[A-Z]?[a-z]{2,}+)+")
#: Names that only a password has.
PASSWORD_NAMES = {"password", "passwort", "passwd", "pwd", "passphrase", "passcode"}
LETTER = re.compile(r"[A-Za-z0-9_]")
#: Long hexadecimal of letters alone; a word with a digit or sign inside; a phrase of four words and more.
HEX = re.compile(r"[a-f]{16,}|[A-F]{16,}")
MIXED = re.compile(r"\d[^\W\d_]|[^\W\d_]\d|\w[!#$%&*+=?@^~]|[!#$%&*+=?@^~]\w")
PHRASE = re.compile(r"[a-z]{3,}(?:[-.][a-z]{3,}){3,}")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: So many characters of a value show whether it is one; its place is that of all of them.
JUDGED = 512


def _words() -> ahocorasick.Automaton:
    """The search part: each word with its length and the entries it leads to."""
    kinds: dict[str, set] = {}
    for prefix in TOKENS:
        kinds.setdefault(prefix, set()).add(("token", prefix))
    for stage in STAGES:
        kinds.setdefault(stage, set()).add(("staged", ""))
    kinds["-----begin "] = {("armor", "")}
    kinds["://"] = {("address", "")}
    for digit in "123456789":
        kinds[f":{digit}"] = {("ported", "")}
    for kind, names in (
        ("name", NAMES), ("header", ("authorization", "private-token", "job-token", "deploy-token", "x-api-key", "x-auth-token", "_authtoken")), ("scheme", ("bearer ", "basic ")),
        ("login", LOGIN_WORDS), ("option", OPTION_WORDS), ("told", TELLING),
    ):
        for name in names:
            kinds.setdefault(name, set()).add((kind, ""))
    words = ahocorasick.Automaton()
    for word, kind in kinds.items():
        words.add_word(word, (len(word), tuple(sorted(kind))))
    words.make_automaton()
    return words


@lru_cache(maxsize=1)
def _parts() -> tuple[ahocorasick.Automaton, Automaton]:
    return _words(), Automaton(TOKENS | GRAMMARS)


#: Formats of a fixed length end where no letter or digit follows.
FIXED = {k for k, p in TOKENS.items() if p.endswith("}") and not p.endswith(",}")}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Chunks overlap by the longest word less one.
OVERLAP = 32


def hits(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, kinds) of every word of the automaton, each once, from chunks that overlap by the longest word."""
    words = _parts()[0]
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    for begin in range(0, len(low), chunk):
        start = max(0, begin - OVERLAP)
        for last, (size, kinds) in words.iter(low[start : begin + chunk]):
            end = start + last + 1
            if end > begin:  # hits that end before this chunk's own part were given by the one before
                yield end - size, end, kinds


class Reader:
    """One text under the table part: codes of its characters, lines, and how far each grammar has been read."""

    def __init__(self, text: str):
        self.text, self.table = text, _parts()[1]
        self.codes = memoryview(self.table.codes(text))
        self.read: dict[str, int] = {}
        self.run: tuple[int, int] = (0, 0)

    def match(self, at: int, grammar: str, shortest: bool = False) -> int:
        """The end of the grammar's word from ``at``, else -1."""
        return self.table.lex(self.codes, at, grammar, shortest)[0]

    def once(self, at: int, grammar: str, shortest: bool = False) -> int:
        """As ``match``, but no place is read twice for one grammar: a start within what was read is part of that word."""
        if at < self.read.get(grammar, 0):
            return -1
        end, self.read[grammar] = self.table.lex(self.codes, at, grammar, shortest)
        return end

    def judged(self, start: int, end: int) -> str:
        """As much of a value as is judged."""
        return self.text[start : min(end, start + JUDGED)]

    def bare(self, at: int) -> int:
        """The end of a bare value; one within the last one read ends where that does."""
        if self.run[0] < at < self.run[1] and self.text[at] not in ",(){}[]":
            return self.run[1]
        end = self.match(at, "bare")
        self.run = (at, end)
        return end

    @cached_property
    def ends(self) -> tuple[list[int], list[int]]:
        """Places of line feeds and of semicolons."""
        return [m.start() for m in re.finditer("\n", self.text)], [m.start() for m in re.finditer(";", self.text)]

    def line(self, at: int) -> int:
        feeds = self.ends[0]
        k = bisect_left(feeds, at)
        return feeds[k - 1] + 1 if k else 0

    def in_pairs(self, at: int) -> bool:
        """Whether a semicolon stands before ``at`` on its line."""
        signs = self.ends[1]
        k = bisect_left(signs, at)
        return bool(k) and signs[k - 1] >= self.line(at)


def plausible(value: str, quoted: bool, password: bool = False) -> bool:
    """Whether a text in a secret's place is a secret rather than a placeholder, a reference or code.

    ``password``: the value stands in quotes after a name that only a password has.  There it may be short, have blanks or
    letters of any alphabet, or be a phrase of words, if it shows by signs and digits that it is no sentence.
    """
    value = value[:JUDGED]
    if not value or PLACEHOLDER.search(value) or REFERENCE.search(value) or HEXHASH.match(value):
        return False
    digits = sum(c.isdigit() for c in value)
    if password and quoted:
        mixed = (digits > 0) + any(c.isalpha() for c in value) + any(not c.isalnum() and not c.isspace() for c in value)
        if PHRASE.fullmatch(value):
            return True
        if any(c.isspace() for c in value):
            return len(value) >= 6 and value == value.strip() and len(value.split()) <= 6 and any(MIXED.search(w) for w in value.split())
        if not value.isascii():
            return mixed >= 2 and not CJK.search(value)
        if len(value) < 6:
            return len(value) >= 3 and mixed >= 2 and MIXED.search(value) is not None
    if len(value) < 6 or any(c.isspace() for c in value) or not value.isascii():
        return False
    if GROUPED.fullmatch(value) or HEX.fullmatch(value):
        return True
    if WORDY.fullmatch(value):
        # Letters alone: a name of something, unless it is long and mixes case as only random letters do.
        if password and value.isalpha() and len(value) >= 9 and not value.islower() and not value.isupper() and not MIXED_WORDS.fullmatch(value):
            return True
        changes = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
        return "_" not in value and len(value) >= 9 and changes >= len(value) // 3 and not CAMEL.fullmatch(value)
    if not quoted and ("(" in value or IDENTIFIER.fullmatch(value) and digits == 0):
        return False
    return digits > 0 or len(set(value)) >= 6


def quoted(r: Reader, at: int) -> tuple[int, int] | None:
    """The span between quotes, which may be escaped, on one line."""
    m = QUOTED.match(r.text, at)
    return m.span(2) if m else None


def name_value(r: Reader, start: int, end: int) -> tuple[int, int] | None:
    """The span of the value set for the name that ends at ``end``."""
    text = r.text
    after = text[end : end + 1]
    if after and (after.isalnum() or after in "_-."):
        return None
    before = text[start - 1] if start else " "
    word = text[start:end]
    # A short word may stand inside another ("bypass", "compass"): there the value must show by itself what it is.
    inside = before.isalpha() and not (word[0].isupper() and before.islower()) and len(word) <= 4 and word.lower() != "pwd"
    at = r.match(end, "xml")
    if at < 0 or text[at : at + 1] not in ("'", '"', "\\"):
        at = r.match(end, "link")
    if at < 0:
        at = end
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if at == end:
            return None
        last = r.bare(at)
        value = (at, last) if last > at else quoted(r, at)
        if not value:
            return None
        if COMMAND.search(text, max(r.line(start), start - 200), start):
            return value if plausible(r.judged(*value), True) else None
        return value if strong(r.judged(*value)) else None
    if after in " \t:" and (typed := r.match(end, "typed")) > 0 and quoted(r, typed):
        at = typed
    if text.startswith('{"', at):
        at = max(at, r.match(at, "nested"))
    if value := quoted(r, at):
        return value if plausible(r.judged(*value), True, word.lower() in PASSWORD_NAMES) and (not inside or strong(r.judged(*value))) else None
    e = r.bare(at)
    while e > at and text[e - 1] in ",)]}\\":
        e -= 1
    return (at, e) if e > at and plausible(r.judged(at, e), False) and (not inside or strong(r.judged(at, e))) else None


def strong(value: str) -> bool:
    """A value that stands after its name with only a blank between must show it by itself: letters mixed with digits."""
    value = value[:JUDGED]
    kinds = (any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value), any(not c.isalnum() for c in value))
    return plausible(value, False) and kinds[0] and sum(kinds) >= 2 and len(value) >= 8 and "/" not in value[:1] and "(" not in value and not SETTING.match(value)


def _token(r: Reader, start: int, prefix: str) -> tuple[int, int] | None:
    if start and LETTER.match(r.text, start - 1) or (end := r.once(start, prefix)) < 0:
        return None
    if prefix in FIXED and r.text[end : end + 1].isalnum() or PLACEHOLDER.search(r.judged(start, end)) or r.text.endswith("EXAMPLE", start, end):
        return None
    return start, end


def _staged(r: Reader, start: int) -> tuple[int, int] | None:
    first = start
    while first and start - first < 11 and "a" <= r.text[first - 1] <= "z":
        first -= 1
    if first == start or first and LETTER.match(r.text, first - 1) or r.text[first:start] in ("pk", "pub", "public") or (end := r.once(first, "staged")) < 0:
        return None
    random = r.text[max(start, end - JUDGED) : end].rpartition("_")[2]
    return (first, end) if any(c.isdigit() for c in random) and not random.islower() and not random.isupper() and not random.endswith("EXAMPLE") else None


def _address(r: Reader, start: int) -> tuple[int, int] | None:
    at = r.match(start, "user")
    if at < 0:
        return None
    # The password ends at the first at sign that a host follows.
    last = r.once(at, "until host")
    end = r.text.find("@", at, last) if last > 0 else -1
    while end >= 0 and not HOST.match(r.text, end + 1):
        end = r.text.find("@", end + 1, last)
    if end - at <= 3 or PLACEHOLDER.search(r.judged(at, end)) or REFERENCE.search(r.judged(at, end)):
        return None
    return at, end


def _named(r: Reader, start: int, end: int) -> tuple[int, int] | None:
    span = name_value(r, start, end)
    # A pair of a connection string ends at its semicolon.
    if r.text[end : end + 1] == "=" and r.text[end + 1 : end + 2] not in ("'", '"', "`") and r.in_pairs(start):
        last = r.match(end + 1, "pair")
        at = end + 1 + (r.text[end + 1 : end + 2] == "{")
        value = r.judged(at, last)
        if last > 0 and (plausible(value, True) or not span and len(value) > 5 and not PLACEHOLDER.search(value) and not REFERENCE.search(value)):
            return at, last
    return span


def _ported(r: Reader, start: int) -> tuple[int, int] | None:
    at = r.match(start, "ported")
    if at < 0 or not PORTED_HOST.fullmatch(r.text, max(r.line(start), start - 260), start):
        return None
    m = PORTED_VALUE.match(r.text, at)
    return m.span(1) if m and plausible(r.judged(*m.span(1)), True) else None


def _header(r: Reader, end: int) -> tuple[int, int] | None:
    at = r.match(end, "header")
    last = r.match(at, "word") if at > 0 else -1
    value = r.judged(at, last)
    if last < 0 or len(value) < 8 or not plausible(value, True) or r.text[end:at].rstrip()[-5:].lower() == "basic" and not _basic(value):
        return None
    return at, last


def spans(text: str | None) -> list[tuple[int, int]]:
    """0-based (start, end) of every credential, in order, none overlapping."""
    if not text:
        return []
    found: set[tuple[int, int]] = set()
    r: Reader | None = None
    for start, end, kinds in hits(text):
        r = r or Reader(text)
        for kind, grammar in kinds:
            span = None
            if kind == "token":
                span = _token(r, start, grammar)
            elif kind == "staged":
                span = _staged(r, start)
            elif kind == "armor":
                span = (start, last) if (last := r.once(start, "armor", True)) > 0 else None
            elif kind == "address":
                span = _address(r, start)
            elif kind == "ported":
                span = _ported(r, start)
            elif kind == "name":
                span = _named(r, start, end)
            elif kind == "header":
                span = _header(r, end)
            elif kind == "login":
                if (m := LOGIN.match(text, end)) and strong(m[1]):
                    span = m.span(1)
            elif kind == "option":
                m = OPTION.match(text, end) if text[start] == " " else LOGIN_FILE.match(text, end)
                if m and len(m[1]) >= 6 and plausible(m[1], True):
                    span = m.span(1)
            elif kind == "told":
                if (m := TOLD.match(text, end)) and len(m[1]) >= 6 and plausible(m[1], True):
                    span = m.span(1)
            elif kind == "scheme":
                if (m := SCHEME.match(text, start)) and any(c.isdigit() for c in m[2]) and (m[1].lower() != "basic" or _basic(m[2])) and plausible(m[2], True):
                    span = m.span(2)
            if span:
                found.add(span)
    # Of overlapping spans the one that starts first, then the longer one, stays: a block holds what stands inside it.
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def _basic(value: str) -> bool:
    """Basic credentials are base64 of user:password."""
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def placeholder(value: str) -> str:
    """As many characters as before, line ends kept, so that lines and later positions stay."""
    return re.sub(r"[^\r\n]", "*", value)


def redact(text: str | None) -> str | None:
    """The text with only the characters of its credentials replaced."""
    for s, e in reversed(spans(text)):
        text = text[:s] + placeholder(text[s:e]) + text[e:]
    return text


def scan_secrets(df: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, start_pos, n_chars, redacted): one row per text that is not null; spans as arrays, in order, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, texts in ((b, *s) for b in batches for s in slices(b.column(1))):
            places = [spans(t) for t in texts]
            clean = [t if not p else _splice(t, p) for t, p in zip(texts, places)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array([[s + 1 for s, _ in p] for p in places], pa.list_(pa.int32())), pa.array([[e - s for s, e in p] for p in places], pa.list_(pa.int32())), pa.array(clean, pa.string())],
                [key, "start_pos", "n_chars", "redacted"],
            )

    schema = T.StructType([df.schema[key], T.StructField("start_pos", T.ArrayType(T.IntegerType())), T.StructField("n_chars", T.ArrayType(T.IntegerType())), T.StructField("redacted", T.StringType())])
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def _splice(text: str, places: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for s, e in places:
        parts += [text[at:s], placeholder(text[s:e])]
        at = e
    return "".join([*parts, text[at:]])


def secret_places(scanned: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, start_pos, n_chars): one row per credential."""
    zipped = F.explode(F.arrays_zip("start_pos", "n_chars")).alias("at")
    return scanned.select(key, zipped).select(key, "at.start_pos", "at.n_chars")
