"""Credentials in source code: their places, and contents with them redacted.

One pass cuts a text into tokens: names, string literals (prefix, delimiters,
escapes, templates within templates), comments, operators, brackets with their
partners, line ends. Contents of literals and comments are cut the same way
again, as they hold commands, settings and prose. Decisions are taken on the
tokens. A literal is a credential if it is assigned or passed to a
credential-named identifier (an assignment, key, attribute, default, setter or
constructor), stands in a place that only takes credentials (user and password
of an address, authorization headers, login calls), or has the public form of a
key; and if its content is no placeholder, reference, prose or id. Bare values
count in configuration, commands, comments and the insides of strings. Only the
content of the literal is replaced: delimiters, escapes and line feeds around
and inside it stay, so the code still parses.

Every character is read once per level of nesting, and every rule looks at
tokens beside the name, so time grows in proportion to the text also where all
of it is one line.

Defined edge cases
    null and empty contents have no findings and come out unchanged; lines are
    counted from 1 at line feeds; repeated rows count once; a literal found by
    several rules is one finding; a literal in pieces (concatenated, or a list that
    is joined) begins at its first piece and is redacted in every piece; of a list
    under a plural name every literal is one finding. A literal that is never
    closed ends with its line, a template or comment with the text. Very long texts
    are read whole. How long a value must be follows from its characters
    (``BITS``): five of mixed case and digits are enough, three small letters are not.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "REDACTED"
#: what a value must hold, in bits: its length times the logarithm of the number of characters of the kinds that it uses
BITS = 28.0

# fixed values: endings of credential names (words joined, lower case), and the last words that make a name one only as a whole word
ENDINGS = tuple(
    "password passwd passphrase pwd secret credential credentials apikey accesskey secretkey privatekey signingkey authkey encryptionkey masterkey authtoken accesstoken webhooktoken "
    "apitoken refreshtoken bearertoken bearer smtppass dbpass userpass mailpass adminpass adminpw rootpw dbpw userpw".split()
)
WORDS = frozenset("pass pw tok auth passcode".split())
PLACEHOLDERS = frozenset(
    "password passwd secret changeme change_me changeit replace_me replaceme todo fixme tbd none null nil undefined true false yes no example dummy placeholder redacted removed hidden "
    "default string str text required optional empty unset test user token key value pass".split()
)
#: fixed values: first words of functions that read, check or make a credential rather than take one
READERS = frozenset(
    "get read load fetch find lookup resolve retrieve require hash check verify validate is has encrypt decrypt compare match reset generate gen make create derive prompt ask input enter forget "
    "forgot test mask redact hide show print log parse decode encode format sanitize strip scan delete remove drop rotate revoke expire label on handle render describe".split()
)
#: fixed values: words that literals with blanks have if they are prose
PROSE = frozenset("a an the your you my is are was be must may can please enter type of to for in on at and or not no with from by it this that should must at least characters".split())

#: what any finding needs, in lower case: plain roots, and forms around commoner words
ROOTS = "pwd secret credential bearer :// akia ghp_ gho_ ghu_ ghs_ ghr_ xox sk_live npm_ aiza eyj login curl basic identified rootpw adminpw".split()
_forms = re.compile(r"(?<!com)pass(?!age|ed|es|ing|ive|ion)|pw(?![a-z])|tok(?!en)|tokens?(?=[\"'`]?[ \t\])]*(?:[:=]|\?|\|\||or\b))")
_keys = re.compile(r"(?:api|access|private|signing|auth|encryption|master|secret)[_.\- ]?key")
_tokens = re.compile(r"(?:auth|access|webhook|api|refresh|bearer)[_.\- ]?token|auth(?!or)|log in")


def hinted(low: str) -> bool:
    """Whether a text in lower case holds anything that a finding needs."""
    return any(root in low for root in ROOTS) or _forms.search(low) is not None or ("key" in low and _keys.search(low) is not None) or (("auth" in low or "oken" in low or "log in" in low) and _tokens.search(low) is not None)


_camel = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_public = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|AIza[\w-]{30,}|(?<![\w-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9])"
)
_url = re.compile(r"://[^\s/:@'\"`<>]+:(?P<v>[^\s/@'\"`<>]+)@[\w.-]")
_bearer = re.compile(r"\b(?P<k>Bearer|Basic|Token)\s+(?P<v>[A-Za-z0-9+/=_.~\-]{12,})")
_pem = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_old_login = re.compile(r"\blog_?in\s+[\w.@-]+\s*[/:]\s*(?P<v>[^\s\"'`]+)", re.I)
_user_flag = re.compile(r"(?:-u|--user)[ =]+[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
_login_call = re.compile(r"(?:^|.*\.)(?:(?:set)?basic_?auth\w*|\w*log_?in|\w*credentials?|\w*authenticate)$", re.I)

_type = re.compile(r"\s*\??\s*:\s*(?:const\s+)?(?:string|String|str|char|text|SecretStr|bytes)(?:\s*\|\s*\w+)*(?=\s*=)")
_assign = re.compile(r"\s*(?:=>|:=|=(?!=)|:(?!:))\s*")
_default = re.compile(r"\s*[\])]*\s*(?:\?\?=?|\|\|=?|\bor\b)\s*")
_passed = re.compile(r"\s*,\s*")
_attribute = re.compile(r"\s+(?:value|val|content|default)\s*=\s*(?=[\"'])", re.I)
_element = re.compile(r">\s*(?P<v>[^<>\s]+)\s*</")
_told = re.compile(r"[\"'`]?\s+(?:is|was|to|are|=|:)\s+|\s+(?=`)")
_said = re.compile(r"\s+(?:is|was|=|:)\s+|:\s+|\s+(?=`)")
_flag_value = re.compile(r"[ =]\s*(?=\S)")
_next_value = re.compile(r"[\"']?[ \t\r]*\n[ \t]*value\s*:\s*")
_bare = re.compile(r"[^\s\"'`,;<>{}()\[\]]+")
_expression = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+\(?|^[A-Za-z_$][\w$.]*\(|^\w+::")
_key_runs = re.compile(r"[A-Za-z0-9+/=]{8,}")
_space = re.compile(r"\s+")
_digits = re.compile(r"\d+")
_setting = re.compile(r"(?:export|ENV|ARG)?[A-Z][A-Z0-9_]*")

DECODERS = frozenset("Buffer.from atob base64.b64decode base64.urlsafe_b64decode b64decode bytes.fromhex String str bytes Secret SecretStr base64.StdEncoding.DecodeString".split())
LISTS = frozenset("List.of Arrays.asList Set.of".split())
LOOKUPS = frozenset("os.environ.get os.getenv getenv env System.getenv".split())

SLASH = frozenset("ts tsx js jsx mjs cjs go java css scss c cc h cpp hpp cs rs php kt swift scala json jsonc".split())
CODE = frozenset("ts tsx js jsx mjs cjs py go java sql css c cpp rs rb php kt cs swift scala".split())
PROSE_FILES = frozenset(("md", "txt"))

# ---- the lexer ----------------------------------------------------------------------------

_quoted = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_triple = r"(?P<t>[bBrRuUfF]{0,2}(?P<q>\"\"\"|''')(?P<tv>(?:[^\\\"']|\\.|(?!(?P=q))[\"'])*)(?:(?P=q)|\Z))"
_rest = r"|(?P<w>[^\W\d][\w$]*(?:[.\-][^\W\d]\w*)*|\$[\w$]*(?:[.\-][^\W\d]\w*)*)|(?P<n>\n)|(?P<b>[^\S\n]+|\d+|[^\x00-\x7f]|\\.|\Z)|(?P<o>=>|:=|===?|!==?|\?\?=?|\|\|=?|&&|->|::|.)"


def _lexer(comment: str, raw: str = "", quoted: str = _quoted) -> re.Pattern:
    return re.compile(rf"(?P<c>{comment})|{_triple}{raw}|(?P<s>[bBrRuUfF]{{0,2}}(?:{quoted}))" + _rest, re.S)


_raw = r"|(?P<r>r(?P<h>#+)\"(?P<rv>.*?)(?:\"(?P=h)|\Z))|(?P<a>\$?@\"(?P<av>(?:[^\"]|\"\")*)\")"
_line_hash = r"(?<!\S)#[^\n]*"
LEXERS = {
    "slash": _lexer(r"//[^\n]*|/\*.*?(?:\*/|\Z)", _raw + r"|(?P<k>`)"),
    "py": _lexer(r"#[^\n]*"),
    "sql": _lexer(r"--[^\n]*|/\*.*?(?:\*/|\Z)"),
    "hash": _lexer(_line_hash + r"|(?m:^)[ \t]*;[^\n]*", quoted=_quoted + r"|`[^`\n]*`"),
}
# prose and insides: an apostrophe inside a word is none that opens; escaped delimiters delimit too
_inner = (r"|(?P<e>\\(?P<eq>[\"'])(?P<ev>[^\\\"'\n]*)\\(?P=eq))", r"\"(?:\\.|[^\"\\\n])*\"|(?<!\w)'(?:\\.|[^'\\\n])*'|`[^`\n]+`")
LEXERS["text"] = _lexer(r"(?m:^)[ \t]*(?://|#|\*|--|;)[^\n]*|(?<=\s)(?://|\#)\s[^\n]*|<!--.*?(?:-->|\Z)|/\*.*?(?:\*/|\Z)", *_inner)
LEXERS["comment"] = _lexer(r"(?!)", *_inner)  # a comment holds no other
_regex = re.compile(r"/(?:\\.|[^/\\\n])+/")
_template = re.compile(r"\\.|`|\$\{|\{|\}", re.S)


def template_end(text: str, at: int, hi: int) -> int:
    """End of the content of the template that begins at ``at``; templates inside its ``${}`` belong to it."""
    inside: list[str] = []  # open braces of substitutions, and templates inside them
    for m in _template.finditer(text, at, hi):
        mark = m.group()
        if mark == "`":
            if not inside:
                return m.start()
            if inside[-1] == "`":
                inside.pop()
            else:
                inside.append("`")
        elif mark == "${":
            if not inside or inside[-1] == "`":
                inside.append("{")
        elif mark == "{":
            if inside and inside[-1] == "{":
                inside.append("{")
        elif mark == "}" and inside and inside[-1] == "{":
            inside.pop()
    return hi


class Tokens:
    """Tokens of ``text[lo:hi]``: kinds (``w`` name, ``s`` literal, ``c`` comment, ``n`` line end, ``o`` operator), places, contents, partners of brackets."""

    def __init__(self, text: str, lo: int, hi: int, mode: str):
        kinds, starts, ends, inner, pair = [], [], [], [], {}
        open_: list[int] = []
        match, at = LEXERS[mode].match, lo
        while at < hi:
            m = match(text, at, hi)
            kind, end = m.lastgroup, m.end()
            if kind == "b":
                at = end
                continue
            span = None
            if kind == "k":
                close = template_end(text, at + 1, hi)
                kind, span, end = "s", (at + 1, close), min(hi, close + 1)
            elif kind == "s":
                a = at
                while text[a] not in "\"'`":
                    a += 1
                span = (a + 1, end - 1)
            elif kind in "trae":
                span = m.span({"t": "tv", "r": "rv", "a": "av", "e": "ev"}[kind])
                kind = "s"
            elif kind == "o":
                c = text[at]
                if c == "/" and mode == "slash" and (not kinds or kinds[-1] in "no" and text[starts[-1]] not in ")]}") and (m := _regex.match(text, at, hi)):
                    at = m.end()
                    continue
                if c in "([{":
                    open_.append(len(kinds))
                elif c in ")]}" and open_:
                    pair[open_.pop()] = len(kinds)
            kinds.append(kind)
            starts.append(at)
            ends.append(end)
            inner.append(span)
            at = end
        self.kinds, self.starts, self.ends, self.inner, self.pair = kinds, starts, ends, inner, pair


# ---- names and values -------------------------------------------------------------------------


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _camel.findall(name)]


def credential_name(name: str) -> bool:
    """Whether a name ends as names of credentials do."""
    words = words_of(name)
    if not words:
        return False
    if words[-1].isdigit() and len(words) > 1:
        words = words[:-1]
    joined = "".join(words[-3:])
    if joined.endswith("compass") or "public" in words:
        return False
    return words[-1] in WORDS or joined.endswith(ENDINGS) or (len(words) == 1 and name.isupper() and bool(re.search(r"(?:SMTP|DB|USER|ADMIN|ROOT|MAIL)(?:PASS|PW)$|[A-Z]{4,}TOK$", name)))


NONE, STRICT, WEAK, PLURAL = range(4)
SPECIAL = 4  # added for names that a rule of their own reads
SPECIAL_NAMES = frozenset("login log key token identified auth curl u user value pass password".split())
_kept: dict[str, int] = {}


def kind_of_name(name: str) -> int:
    """Whether a name is a credential's, the plural of one, or a token's, which need not be secret; kept per worker, as names repeat."""
    kind = _kept.get(name)
    if kind is None:
        if len(_digits.findall(name)) > 2:
            kind = NONE  # encoded data rather than a name
        elif credential_name(name) or credential_name(name.rsplit("-", 1)[-1]):
            kind = STRICT
        elif (last := words_of(name)[-1:]) == ["token"]:
            kind = WEAK
        elif last and last[0].endswith("s") and (credential_name(name[:-1]) or last[0] == "tokens"):
            kind = PLURAL
        else:
            kind = NONE
        if name.lower() in SPECIAL_NAMES or _login_call.match(name):
            kind += SPECIAL
        if len(_kept) >= 1 << 17:
            _kept.clear()
        _kept[name] = kind
    return kind


def bits(value: str) -> float:
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for test, n in kinds if any(map(test, value))) + (32 if any(not c.isalnum() for c in value) else 0)
    return len(value) * math.log2(size or 32)


def phrase_value(value: str) -> bool:
    """Whether a literal with blanks is a value of several words rather than prose: digits in it, and no word of prose."""
    parts = value.lower().split()
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not PROSE.intersection(p.strip(".,:;!?") for p in parts) and not value.rstrip().endswith((":", "?", "...")) and all(re.search(r"\d", p) or p.isalpha() for p in parts) and sum(bool(re.search(r"\d", p)) for p in parts) * 2 >= len(parts)


def placeholder(value: str, blanks: bool = False) -> bool:
    """Whether a literal's content is a placeholder, a reference or prose rather than a value."""
    v = value.strip()
    low = v.lower()
    if bits(v) < BITS or low in PLACEHOLDERS or re.fullmatch(r"[A-Za-z][A-Za-z ]*[:?]", v):
        return True
    if any(c.isspace() for c in v):
        return not (blanks and phrase_value(v))
    if re.fullmatch(r"[*xX#.?_\-0]+|\$\w+|%\w+%|<[^<>]*>|\[[^\[\]]*\]|\{+.*\}+|\$\{.*|\$\(.*|@\w+@|__\w+__", v):
        return True
    if "${" in v or "{{" in v or "<your" in low or low.startswith(("your_", "your-", "my_", "my-", "./", "../", "/run/", "/etc/", "/var/", "vault:", "vault/", "!vault", "env:", "file:", "ref:", "secret/", "ssm:", "arn:", "op://", "data:", "sha256", "sha384", "sha512")):
        return True
    if re.search(r"(?:^|[_\-.])(?:here|placeholder|example|changeme|replace(?:_?me)?|dummy|sample)(?:$|[_\-.])", low):
        return True
    if re.fullmatch(r"\d+(?:\.\d+)?(?:ms|s|m|h|d)?", v) or re.fullmatch(r"[a-zA-Z][a-zA-Z0-9+.-]*://\S*", v):
        return True
    # the name of a setting rather than its value
    return not re.search(r"\d", v) and bool(re.fullmatch(r"[A-Za-z_]\w*(?:[_.\-]\w+)*", v)) and credential_name(v)


def strong(value: str) -> bool:
    """Whether a value looks random: long, with digits and letters, and no words joined by marks."""
    return len(value) >= 16 and bool(re.search(r"\d", value) and re.search(r"[A-Za-z]", value))


def decoded(value: str) -> str | None:
    try:
        return base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None


# ---- decisions on the tokens ------------------------------------------------------------------------


class Scanner:
    """Findings of one text: groups of (start, end) spans, the first of which is where the value begins."""

    def __init__(self, text: str, ext: str):
        self.text, self.ext = text, ext
        self.low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.groups: list[list[tuple[int, int]]] = []
        self.spans: list[tuple[int, int]] = []  # of all groups, sorted; they do not overlap

    def add(self, *spans: tuple[int, int]) -> bool:
        for a, _ in spans[:1]:
            i = bisect_right(self.spans, (a, len(self.text) + 1)) - 1
            if i >= 0 and (self.spans[i][0] == a or a < self.spans[i][1]):
                return True
        self.groups.append(list(spans))
        for s in spans:
            insort(self.spans, s)
        return True

    def run(self) -> list[list[tuple[int, int]]]:
        text = self.text
        for m in _pem.finditer(text):
            body = re.sub(r"\\[nrt]|[\s\"'+,|>#*/]", "", m.group("v"))
            if len(re.sub(r"[^A-Za-z0-9=]", "", body)) >= 40:
                runs = [x.span() for x in _key_runs.finditer(text, *m.span("v"))]
                escaped = [(a + 1, b) if text[a - 1 : a] == "\\" and text[a] in "nrt" else (a, b) for a, b in runs]
                self.groups.append([(m.start(), m.start()), *escaped])
                for s in escaped:
                    insort(self.spans, s)
        for m in _url.finditer(text):
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "+.-"):
                if not placeholder(m.group("v").replace("%", "")) and not re.fullmatch(r"[A-Z_]+", m.group("v")):
                    self.add(m.span("v"))
        for m in _bearer.finditer(text):
            if not placeholder(m.group("v")):
                inner = decoded(m.group("v")) if m.group("k") == "Basic" else None
                if m.group("k") == "Bearer" or (inner and ":" in inner and not placeholder(inner.split(":", 1)[1])):
                    self.add(m.span("v"))
        ext = self.ext
        mode = "slash" if ext in SLASH else ext if ext in ("py", "sql") else "text" if ext in PROSE_FILES or ext in ("xml", "html", "") else "hash"
        # what is still to be read: place, lexer, whether bare values count, whether it is a comment
        self.todo = [(0, len(text), mode, ext not in CODE, False)]
        while self.todo:
            self.read(*self.todo.pop())
        for m in _public.finditer(text):  # last, as a value in pieces is known as a whole by its name
            self.add(m.span())
        return self.groups

    # ---- one range ----

    def read(self, lo: int, hi: int, mode: str, bare: bool, comment: bool) -> None:
        text, t = self.text, Tokens(self.text, lo, hi, mode)
        self.t, self.bare, self.comment, self.hi = t, bare, comment, hi
        self.known: dict[int, tuple[int, bool]] = {}  # where a value's wrapping ends, by token
        self.at_token = {a: i for i, a in enumerate(t.starts)}
        self.bare_end = lo
        prose = comment or self.ext in PROSE_FILES
        curl = code = False  # of this line: a curl command, words of code
        auth = False  # inside the braces of an auth object
        kinds, starts, ends = t.kinds, t.starts, t.ends
        for i, kind in enumerate(kinds):
            if kind == "n":
                curl = code = False
            elif kind == "w":
                name = text[starts[i] : ends[i]]
                if self.ext == "md":
                    code = code or name.split(".")[0] in ("const", "let", "var", "self", "this", "func", "def", "return")
                    self.bare = bare and (comment or not code or lo > 0) or bool(_setting.fullmatch(name))
                if not kind_of_name(name):
                    continue
                if name == "curl":
                    curl = True
                elif curl and name in ("u", "user") and text[starts[i] - 1 : starts[i]] == "-":
                    m = _user_flag.match(text, starts[i] - (2 if name == "user" else 1), hi)
                    if m and not placeholder(m.group("v")):
                        self.add(m.span("v"))
                self.name(i, name, prose, quoted=None)
                auth = self.auth_object(i, name, auth)
            elif kind == "s":
                a, b = t.inner[i]
                if b - a <= 128 and (m := _whole_name.fullmatch(text, a, b)) and kind_of_name(m.group()):
                    self.name(i, m.group(), prose, quoted=(a, b))
                    auth = self.auth_object(i, m.group(), auth)
                if self.bare_matters(a, b):
                    self.todo.append((a, b, "comment" if comment else "text", True, comment))
            elif kind == "c":
                if self.bare_matters(starts[i], ends[i]):
                    a = starts[i]
                    while a < ends[i] and (text[a].isspace() or text[a] in "/#*-;<!"):
                        a += 1
                    self.todo.append((a, ends[i], "comment", True, True))
            elif text[starts[i]] in "{}" and text[starts[i]] == "}":
                auth = False
            elif text[starts[i]] in ";{":
                code = True

    def bare_matters(self, a: int, b: int) -> bool:
        return b - a > 3 and hinted(self.low[a:b])

    def follows(self, i: int, what: str) -> bool:
        return i < len(self.t.kinds) and self.text.startswith(what, self.t.starts[i]) and self.t.kinds[i] == "o"

    def auth_object(self, i: int, name: str, auth: bool) -> bool:
        """``auth: {user: ..., value: "..."}``: state of the object, and its literal."""
        low = name.lower()
        if low == "auth" and i + 2 < len(self.t.kinds) and self.text[self.t.starts[i + 1]] in ":=" and self.follows(i + 2, "{"):
            return True
        if auth and low in ("value", "pass", "password", "key", "token") and i + 2 < len(self.t.kinds) and self.text[self.t.starts[i + 1]] in ":=" and self.t.kinds[i + 2] == "s":
            a, b = self.t.inner[i + 2]
            if not placeholder(self.text[a:b]):
                self.add((a, b))
        return auth

    def name(self, i: int, name: str, prose: bool, quoted: tuple[int, int] | None) -> None:
        text, t = self.text, self.t
        start, end = quoted or (t.starts[i], t.ends[i])
        low = name.lower()
        if low in ("login", "log") and prose and (m := _old_login.match(text, start, self.hi)) and not placeholder(m.group("v")):
            self.add(m.span("v"))
        if low in ("key", "token") and prose and i and t.kinds[i - 1] == "w" and t.ends[i - 1] == t.starts[i] - 1:
            before = text[t.starts[i - 1] : t.ends[i - 1]].lower()
            if before in ("api", "access", "auth") or before in (("private", "signing", "encryption", "master", "secret") if low == "key" else ("webhook", "refresh", "bearer")):
                m = _said.match(text, end, self.hi)
                self.in_reference = False
                if m and self.value(m.end(), True):
                    return
        if not quoted:
            self.call(i, name)
        if low == "identified" and (m := re.compile(r"\s+BY\s+(?=['\"])", re.I).match(text, end, self.hi)):
            self.in_reference = False
            self.value(m.end(), False)
        kind = kind_of_name(name) % SPECIAL
        if kind:
            self.named(i, name, start, end, kind, prose, quoted is not None)

    def call(self, i: int, name: str) -> None:
        """Logins with user and password; setters and constructors of credentials."""
        t, n = self.t, len(self.t.kinds)
        auth = name.lower() == "auth" and self.follows(i + 1, "=") and self.follows(i + 2, "(")
        at = i + 2 if auth else i + 1
        if not self.follows(at, "(") or at + 1 >= n or t.kinds[at + 1] != "s":
            return
        second = at + 3 if self.follows(at + 2, ",") else None
        if auth or _login_call.match(name):
            if second is not None and second < n and t.kinds[second] == "s" and not placeholder(self.text[slice(*t.inner[second])]):
                self.add(t.inner[second])
            return
        last = name.rsplit(".", 1)[-1]
        if kind_of_name(last) % SPECIAL != STRICT or words_of(last)[0] in READERS or name in DECODERS or words_of(last)[-1] in ("auth", "tok"):
            return
        if at in t.pair and (t.pair[at] == at + 2 or second is not None and second < n):
            spans = self.literal(at + 1, False)
            joined = "".join(self.text[a:b] for a, b in spans)
            if t.pair[at] == at + 2 and not placeholder(joined) and "-----BEGIN" not in joined and not joined.startswith(("/", "#", ".")):
                self.add(*spans)

    def literal(self, i: int, in_list: bool) -> list[tuple[int, int]]:
        """Content spans of the string literal at token ``i``, with the pieces that continue it."""
        t, text = self.t, self.text
        spans = []
        while i < len(t.kinds) and t.kinds[i] == "s":
            spans.append(t.inner[i])
            j, line, glue = i + 1, False, ""
            while j < len(t.kinds) and (t.kinds[j] == "n" or (not glue and t.kinds[j] == "o" and text[t.starts[j]] in ",+.&" and t.ends[j] - t.starts[j] == 1)):
                line |= t.kinds[j] == "n"
                glue += text[t.starts[j]] if t.kinds[j] == "o" else ""
                j += 1
            if not glue and j < len(t.kinds) and "\\" in text[t.ends[j - 1] - 1 : t.starts[j]]:
                glue = "\\"
            # operators join pieces anywhere; a comma or nothing does so between the lines of a list or brackets
            if glue in ("", ",") and not (in_list and line):
                break
            i = j
        return spans

    def unwrap(self, i: int) -> tuple[int, bool]:
        """Token behind calls, brackets and defaults that wrap a value at ``i``, and whether a list was opened."""
        t, text, n = self.t, self.text, len(self.t.kinds)
        in_list, way = False, []
        while i < n:
            if i in self.known:
                end, more = self.known[i]
                i, in_list = end, in_list or more
                break
            way.append((i, in_list))
            kind = t.kinds[i]
            if kind == "n":
                i += 1
            elif kind == "o":
                if text[t.starts[i]] in "([{":
                    in_list = True
                elif text[t.starts[i] : t.ends[i]] != "&":
                    break
                i += 1
            elif kind == "w":
                name = text[t.starts[i] : t.ends[i]]
                if name in ("await", "new", "return"):
                    i += 1
                    continue
                if name in LOOKUPS and self.follows(i + 1, "(") and i + 3 < n and t.kinds[i + 2] == "s" and self.follows(i + 3, ","):
                    i += 4
                    continue
                j = i + 1
                while self.follows(j, "[") and j in t.pair:
                    j = t.pair[j] + 1
                if self.follows(j, "(") and j in t.pair and name not in LISTS and name not in DECODERS:
                    j = t.pair[j] + 1
                if j < n and (self.follows(j, "??") or self.follows(j, "||") or (t.kinds[j] == "w" and text[t.starts[j] : t.ends[j]] == "or")):
                    i = j + 1
                    continue
                if name in DECODERS and self.follows(i + 1, "("):
                    i += 2
                elif name in LISTS and self.follows(i + 1, "("):
                    i, in_list = i + 2, True
                elif name == "Base64.getDecoder" and self.follows(i + 1, "(") and text.startswith(").decode(", t.starts[min(i + 2, n - 1)]):
                    i += 6
                elif self.follows(i + 1, "(") and i + 4 < n and t.kinds[i + 2] == "w" and text[t.starts[i + 2] : t.ends[i + 2]] in LOOKUPS:
                    i += 2
                else:
                    break
            else:
                break
        for j, before in way:
            self.known.setdefault(j, (i, in_list and not before))
        return i, in_list

    def value(self, at: int, bare: bool, kind: int = STRICT) -> bool:
        """Whether a credential's value stands at ``at``, behind calls, brackets and defaults; it is added then."""
        t, text = self.t, self.text
        first = self.at_token.get(at)
        i, in_list = self.unwrap(first) if first is not None else (None, False)
        if i is not None and i < len(t.kinds) and t.kinds[i] == "s":
            if kind == PLURAL:
                return in_list and self.members(i)
            spans = self.literal(i, in_list)
            j = i + 2 * len(spans) - 1
            if in_list and len(spans) == 1 and self.follows(i + 1, ",") and i + 2 < len(t.kinds) and t.kinds[i + 2] == "s":
                return False  # a tuple of user and password is the logins' rule
            joined = "".join(text[a:b] for a, b in spans)
            if "-----BEGIN" in joined:
                return False  # the rule of key blocks decides
            if joined.startswith(("Bearer ", "Basic ", "Token ")):
                return False
            if placeholder(joined, blanks=j > 0 and not self.comment and self.ext != "md") or (kind == WEAK and not strong(joined)):
                return False
            return self.add(*spans)
        if not bare or kind == PLURAL:
            return False
        if i is not None and i != first and i < len(t.kinds):
            at = t.starts[i]
        if self.in_reference:  # ${NAME:-default} of a shell, ${NAME:?message}
            if text[at : at + 1] == "?":
                return False
            at += text[at : at + 1] in ("-", "=")
        if at < self.bare_end:
            return False  # inside a value that was read
        m = _bare.match(text, at, self.hi)
        if not m:
            return False
        self.bare_end = m.end()
        v = m.group().rstrip(".:") if self.ext == "md" or self.comment else m.group()
        if _expression.match(v) and not re.search(r"\d", v):
            return False
        if placeholder(v) or (v.isalpha() and len(v) < 8) or (kind == WEAK and not strong(v)):
            return False
        return self.add((m.start(), m.start() + len(v)))

    def members(self, i: int) -> bool:
        """The literals of a list under a plural name, each by itself."""
        t, some = self.t, False
        while i < len(t.kinds) and t.kinds[i] == "s":
            v = self.text[slice(*t.inner[i])]
            if not placeholder(v) and bool(re.search(r"\d", v)):
                some = self.add(t.inner[i])
            i += 1
            while i < len(t.kinds) and (t.kinds[i] == "n" or self.follows(i, ",")):
                i += 1
        return some

    def named(self, i: int, name: str, start: int, end: int, kind: int, prose: bool, quoted: bool) -> bool:
        text = self.text
        self.in_reference = text[max(0, start - 2) : start] == "${"
        bare, hi = self.bare, self.hi
        if quoted:
            end = self.t.ends[i]
        after = end
        if text[after : after + 1] == "]" or (quoted and text[after : after + 1] == ")"):
            after += 1
        if m := _type.match(text, after, hi):
            after = m.end()
        m = _assign.match(text, after, hi) or _default.match(text, end, hi)
        if m and "\n" not in m.group().rstrip("\n \t\r"):
            if self.value(m.end(), bare and "\n" not in m.group(), kind):
                return True
        if kind != STRICT:
            return False
        if quoted and (m := _passed.match(text, end, hi)) and self.value(m.end(), False):
            return True
        if quoted and (m := _attribute.match(text, end, hi)) and self.value(m.end(), False):
            return True
        if (m := _next_value.match(text, end, hi)) and self.value(m.end(), True):
            return True
        if text[start - 1 : start] == "<" and (m := _element.match(text, end, hi)) and not placeholder(m.group("v")):
            return self.add(m.span("v"))
        if prose and (m := _told.match(text, end, hi)) and self.value(m.end(), True):
            return True
        if text[max(0, start - 2) : start] == "--" and (m := _flag_value.match(text, end, hi)) and self.value(m.end(), True):
            return True
        if self.ext == "sql" and (m := _space.match(text, end, hi)) and self.value(m.end(), False):
            return True
        t = self.t
        if i >= 2 and t.kinds[i - 1] == t.kinds[i - 2] == "w" and text[t.starts[i - 2] : t.ends[i - 2]] == "login" and (m := _space.match(text, end, hi)):
            return self.value(m.end(), True)
        return False


_whole_name = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_]\w*)*")


def scan(text: str | None, path: str | None = None) -> list[list[tuple[int, int]]]:
    """Groups of content spans; each group is one credential."""
    if not text or not hinted(text.lower()):
        return []
    name = (path or "").rsplit("/", 1)[-1].lower()
    ext = re.sub(r"\.(?:orig|bak|sample)$", "", name).rsplit(".", 1)[-1] if "." in name else ""
    return Scanner(text, ext).run()


def lines_of(text: str, groups: list[list[tuple[int, int]]]) -> list[int]:
    feeds = [i for i, c in enumerate(text) if c == "\n"] if groups else []
    return sorted({bisect_right(feeds, g[0][0] - 1) + 1 for g in groups})


def redact(text: str | None, groups: list[list[tuple[int, int]]], mark: str = MARK) -> str | None:
    """The text with the first piece of each credential replaced by ``mark`` and its other pieces emptied; a key block keeps its frame and line feeds."""
    if not groups:
        return text
    cuts = sorted((a, b, k) for g in groups for k, (a, b) in enumerate(x for x in g if x[1] > x[0]))
    out, at = [], 0
    for a, b, k in cuts:
        if a < at:
            continue
        out += [text[at:a], mark if k == 0 else ""]
        at = b
    return "".join(out) + text[at:]


def _run(with_text: bool, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for table, key, text, path in zip(pdf.src_table, pdf.src_id, pdf.content, pdf.path):
                groups = scan(text, path)
                if with_text:
                    rows.append((table, key, len(groups), redact(text, groups)))
                elif groups:
                    rows += [(table, key, n) for n in lines_of(text, groups)]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def sources(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contents of both tables as ``src_table, src_id, content, path``."""
    a = files.select(F.lit("scanned_files").alias("src_table"), F.col("file_id").cast("string").alias("src_id"), "content", F.col("file_path").alias("path"))
    b = chunks.select(F.lit("chunks").alias("src_table"), F.col("id").alias("src_id"), "content", F.col("file_path").alias("path"))
    return a.unionAll(b)


def places(rows: DataFrame) -> DataFrame:
    """Distinct ``src_table, src_id, line_no`` of the lines on which credentials begin."""
    some = rows.where(F.col("content").isNotNull() & (F.col("content") != ""))
    return some.mapInPandas(_run(False, ["src_table", "src_id", "line_no"]), "src_table string, src_id string, line_no int").distinct()


def redacted(rows: DataFrame) -> DataFrame:
    """``src_table, src_id, n_credentials, content`` of every row, credentials redacted."""
    return rows.mapInPandas(_run(True, ["src_table", "src_id", "n_credentials", "content"]), "src_table string, src_id string, n_credentials int, content string")
