"""Personal data (1), with built-in functions only: candidate spans, boosted trees, calibrated thresholds.

Base spans are fixed by format: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check and
international phone numbers. High-recall generators propose further, possibly overlapping spans: spelt-out
addresses, national phone numbers, IPv6, IBAN, identity numbers, secrets by shape and values assigned to
words such as "token". Each candidate gets format features and features of the text just before and after it,
all defined by one table of patterns. Gradient-boosted trees of depth 3 score it. They are fitted with numpy on TRAIN examples
of one family of carriers, sentences in four languages that hold personal data or look-alikes (digests, commits, dates, versions,
order numbers, serial numbers); the threshold of each kind is the least that keeps PRECISION on a second family, whose
sentences and look-alikes the trees haven't seen, and a third one measures both (tests and README). Trees see only what generators propose in
a sentence. What accepted candidates cover outside of base spans becomes spans; candidates that touch or overlap become one.

The trees become CASE expressions over features that are worked out once a candidate, so scoring stays on the scan: no shuffle, no Python on executors.
Places are sums of the lengths of what lies between matches (code points). Sums and maxima of the first i values come from LEVELS levels of
blocks, bound once a text, so a text with n matches costs n * LEVELS * BLOCK steps at most; no list grows by copies. Redaction cuts
from chunks of CHUNK characters and joins once. The patterns use possessive repeats, bound no secret's length and don't recurse with the length of the text.

Defined results: null or empty texts have no spans; equal rows give equal rows; null ids stay null; empty
tables give empty results; other columns stay as they are (redact) or aren't read (find).
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "identity", "secret")
#: Prefix sums and maxima of n values come from LEVELS levels of blocks of BLOCK.
BLOCK, LEVELS = 32, 4
#: Characters of a chunk of text that redaction cuts from, and of the least piece of a candidate beside base spans.
CHUNK, LEAST = 1024, 4
TRAIN = 6000
ROUNDS = 30
PRECISION = 0.97
CONTEXT = 40

_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base patterns; possessive, and tried only where an earlier start in the same run could not fail alike.
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

_WORDS = r"(?:password|passwort|passwd|passphrase|token|contraseña|mot\x20de\x20passe|key)"
_NAMES = r"(?:token|secret|password|passwd|passphrase|pwd|api_?key|access_key|private_key|signing_key|encryption_key)"
_KEY = r"[A-Z\x20]{0,30}PRIVATE\x20KEY"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: Secrets by what stands before them (a word and "is", a name and "=" or ":", a scheme of authorization), or by their own shape.
_SECRETS = (
    rf"(?<=(?i:{_WORDS})\x20(?i:is|was|ist|lautet|est|es)\x20{{1,2}}[\"'«]{{0,1}})[^\s\"'»]{{6,}}+",
    rf"(?<=(?i:{_NAMES})[\"']{{0,1}}\x20{{0,2}}[=:]\x20{{0,2}}[\"']{{0,1}})(?!(?i:bearer|basic)\x20)[^\s\"']{{6,}}+",
    r"(?<=(?i:bearer|authorization:\x20basic|authorization:\x20token)\x20{1,2})[A-Za-z0-9._~+/=-]{8,}+",
    r"(?=[A-Fa-f]{0,31}[0-9])(?=[0-9]{0,31}[A-Fa-f])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
    r"eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?+",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"(?i:gh[pousr]_|sk-|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,}+",
)
#: A private key's block; at most 40 dashes within, so a block without its end stops at the next dashes.
_PEM = rf"-----BEGIN\x20{_KEY}-----[^-]*+(?:-(?!----)[^-]*+){{0,40}}+(?:-----END\x20{_KEY}-----)?+"

#: Candidate generators: kind of a match, its pattern, and a cheap test that texts without matches fail. No pattern bounds the length of a secret.
GENERATORS = {
    "email": (r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,40}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}+){1,4}+", r"[({\[]at[)}\]]|\x20at\x20[A-Za-z0-9-]+(?:\x20dot|\.[A-Za-z])"),
    "ip": (rf"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{{1,4}}+:){{3,7}}+[0-9A-Fa-f]{{1,4}}+|{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9A-Fa-f]::|::[0-9A-Fa-f]"),
    "phone": (r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "identity": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": (rf"{_PEM}|(?<![A-Za-z0-9])(?:{'|'.join(_SECRETS)})", rf"[0-9A-Fa-f]{{32}}|AKIA|ASIA|eyJ|PRIVATE\x20KEY|(?i:{_WORDS}\x20(?:is|was|ist|lautet|est|es)\x20|gh[pousr]_|sk-|xox|glpat-|bearer\x20|authorization:|{_NAMES}[\"']?\x20{{0,2}}[=:])"),
}

#: Features: of the match, the text before or the text after it; "n" counts matches of the pattern, "?" tests it.
FEATURES = (
    ("match", "n", r"[0-9]"),
    ("match", "n", r"[A-Za-z]"),
    ("match", "n", r"[A-Z]"),
    ("match", "n", r"[\x20.:()-]"),
    ("match", "n", r"[^A-Za-z0-9\x20.:()-]"),
    ("match", "?", r"^[0-9A-Fa-f]+$"),
    ("match", "?", r"[a-z].*[0-9]|[0-9].*[a-z]|[A-Z].*[0-9]|[0-9].*[A-Z]"),
    ("match", "?", r"^(?:0|\(0|1|\(1)"),
    ("match", "?", r"^(?:[09]|666)|-00-|-0000$"),
    ("match", "?", r"[(\[{]"),
    ("match", "?", r"\x20dot\x20|\.[a-z]{2,4}$"),
    ("match", "?", r"\x20"),
    ("match", "?", r"(?i)^[a-z]+[.,;:!?]*$"),
    ("match", "?", r"\$\{|\$\(|^[$%<{]|[A-Za-z0-9_]\(|\[[\"'A-Za-z]|^[A-Za-z_]+\.[A-Za-z_.]+[,;)]*$"),
    ("match", "?", r"::"),
    ("match", "?", r"^(?:eyJ|-----BEGIN|AKIA|ASIA|(?i:gh[pousr]_|sk-|xox|glpat-))"),
    ("match", "?", r"(?i)^(?:your|my|none|null|true|false|undefined|example|changeme|xxx|self|process|this|string|required|optional)"),
    ("before", "?", r"(?i)(?:bearer|authorization:[^\n]{0,8})\x20$"),
    ("before", "?", r"(?i)(?:token|key|secret|passw|passphrase|contrase|mot\x20de\x20passe|pwd|auth|bearer|credential)[^\n]{0,16}$"),
    ("before", "?", r"(?i)(?:phone|tel|call|mobil|fax|cell|contact|ring|dial|llam|appel|anruf|nummer)[^\n]{0,24}$"),
    ("before", "?", r"(?i)(?:iban|account|acct|bank|konto|compte|cuenta)[^\n]{0,24}$"),
    ("before", "?", r"(?i)(?:ssn|social|identity|passport|insurance|tax)[^\n]{0,24}$"),
    ("before", "?", r"(?i)(?:sha|md5|crc|hash|digest|checksum|sum|commit|revision|etag|uuid|blob|fingerprint|build|object)[^\n]{0,28}$"),
    ("before", "?", r"(?i)(?:order|invoice|version|isbn|issn|page|fig|item|ref|part|serial|ticket|batch|lot|sku|parcel|model|release|score|time|clock)[^\n]{0,24}$"),
    ("before", "?", r"(?i)(?:mail|write\x20to|reach|address|contact|send|schreib|écri|escrib)[^\n]{0,24}$"),
    ("before", "?", r"[=:]\x20{0,2}[\"']?$"),
    ("before", "?", r"[\"'«]$"),
    ("before", "?", r"(?i)\x20(?:is|was|ist|est|es|lautet)\x20{1,2}[\"'«]?$"),
    ("before", "?", r"[0-9A-Za-z][.:-]?$"),
    ("after", "?", r"^[.:-]?[0-9A-Za-z%]"),
    ("after", "?", r"^[\"'»]"),
)

#: Carriers: for each family and kind, sentences that hold personal data (#) and sentences that hold look-alikes.
_CARRIERS = {
    "fit": {
        "email": (("write to #", "contact: #", "you reach me at #.", "mail # for details", "# is my address", "écrivez à #", "Schreib an #,"), ("we met # yesterday", "look # later", "the boat lay #,", "he pointed # and")),
        "ip": (("host # answered", "from # port 22", "address: #", "route via #", "ping #"), ("the clock showed #", "duration #,", "time code # of the film", "ratio # in")),
        "phone": (("call #", "tel: #", "my mobile is #", "phone #, evenings", "Fax #", "appelez le #", "ring # now"), ("order #", "part no. #", "version #", "serial #,", "ISBN # (paper)", "item # of the list")),
        "iban": (("IBAN #", "account: #", "pay to bank account #", "Konto #", "compte # svp"), ("serial #", "part #", "licence plate code #", "ref: #", "parcel # left")),
        "identity": (("SSN #", "social security: #", "identity number #", "his social is #."), ("order #", "ticket # closed", "room #", "batch #,", "item: #")),
        "secret": (('token = "#"', "api_key=#", "password: #", "secret: '#'", "Authorization: Bearer #", "my password is #", "TOKEN=#", "the key was #", 'passwd = "#";', "Passwort ist #", "aws_secret_access_key = #", '{"token": "#"}'), ("commit #", "md5=#", "checksum: #", "sha256 # of the image", "ETag: \"#\"", "revision # broke it", "the sha1 of the archive is #")),
    },
    "calibrate": {
        "email": (("send it to # today", "ask # about it", "my mail: #", "escriba a #", "- # (office)"), ("they arrived # noon and", "stay # home", "sold # last", "good # it")),
        "ip": (("server #:", "client [#]", "listens on #", "blocked #"), ("at # sharp", "lap #;", "from minute # on", "offset #")),
        "phone": (("reach us on #", "cell: #", "Anruf unter #", "dial # for help", "contact # or"), ("invoice #", "model #", "ref #", "lot # expires", "release # notes")),
        "iban": (("transfer to #", "bank details: #", "cuenta #", "acct #"), ("model #", "sku #", "batch # of", "case #")),
        "identity": (("ssn: #", "insurance no #", "tax identity #", "passport/social #"), ("invoice #", "version #", "fig. #", "score #")),
        "secret": (("secret = #", 'api_key: "#"', "password=#", "export AUTH_TOKEN=#", "token: #", "the password was #", "mot de passe est #", "credentials key: #", "Authorization: Bearer #", "private_key=#", '"secret": "#",'), ("the md5 of the file: #", "blob #", "build #", "digest #", "fingerprint #,", "hash of the text: #", "uuid #")),
    },
    "test": {
        "email": (("questions? # please", "mailto #", "you may reach # any time", "Adresse: #"), ("he laughed # them", "we waited # dawn", "thrown # me")),
        "ip": (("peer # timed out", "gateway: #", "login from #"), ("start # end", "runtime #", "clock: #")),
        "phone": (("phone us: #", "call me at #", "mobile #;", "Llama al #"), ("ticket #", "part: #", "page # ff", "order no #")),
        "iban": (("bank: #", "IBAN: #", "account no. #"), ("serial no #", "lot #", "parcel #")),
        "identity": (("social: #", "identity #", "SSN is #"), ("ref. #", "order # of", "lot #")),
        "secret": (('secret_token = "#"', "password: '#'", "api_key=#,", "the token is #", "authorization: bearer #", "contraseña es #", "secret_access_key: #"), ("sha #", "object #", "commit id #", "md5 sum: #", "etag #", "the checksum of the disc was #")),
    },
}
FAMILIES = tuple(_CARRIERS)


def examples(n: int, family: str) -> list[tuple[int, str, str, str, int]]:
    """(kind, match, before, after, label) of generated personal data and look-alikes in a family's carriers."""
    r = random.Random(17 + FAMILIES.index(family))
    word = lambda lo=3, hi=9: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(lo, hi)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    code = lambda k, s="0123456789abcdef": "".join(r.choice(s) for _ in range(k))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    filler = lambda: " ".join(r.choice((word(), word(), word(2, 4), digits(r.randint(1, 4)), word().title(), word() + r.choice(".,;"))) for _ in range(r.randint(0, 6)))
    out = []
    for _ in range(n):
        kind = r.choice(KINDS[:2] + KINDS[3:])
        label = int(r.random() < 0.5)
        carrier = r.choice(_CARRIERS[family][kind][1 - label])
        if kind == "email":
            at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), (" at ", ".")))
            m = word() + r.choice(("", "." + word(), digits(2))) + at + word() + dot + r.choice(("com", "org", "net", "de", "fr", "edu"))
            m = m if label else word() + " at " + word() + r.choice((". " + word(), "." + word(5, 9).title()))
        elif kind == "ip":
            short = r.choice(("2001:db8", "fe80", "2a02:" + code(4), "fd" + code(2) + ":" + code(4), code(4), "")) + "::" + ":".join(code(r.randint(1, 4)) for _ in range(r.randint(0, 3)))
            m = r.choice((":".join(code(r.randint(1, 4)) for _ in range(8)), short if re.search("[0-9]", short) else "::1"))
            names = "::".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(2))
            m = m if label else r.choice((":".join(digits(2) for _ in range(r.choice((4, 4, 5)))), names, names.title()))
        elif kind == "phone":
            sep = r.choice(".- ")
            m = r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(f"{r.randint(200, 989)}", digits(3), digits(4))
            m = m if label or r.random() < 0.5 else r.choice("01") + digits(2) + sep + digits(3) + sep + digits(4)
        elif kind == "iban":
            m = code(2, alnum[:26]) + digits(2) + (digits(r.choice((14, 16, 18))) if label else code(r.choice((8, 12, 16)), alnum))
        elif kind == "identity":
            m = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            m = m if label or r.random() < 0.5 else r.choice(("000-", "9" + digits(2) + "-", "666-")) + digits(2) + "-" + digits(4)
        else:
            m = code(r.choice((32, 40, 64)))
            if label and r.random() < 0.6:
                both = alnum + alnum.lower()
                long = "eyJ" + code(r.randint(16, 60), both) + "." + code(r.randint(20, 200), both + "_-") + "." + code(43, both + "_-")
                pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(code(64, both + "+/") for _ in range(r.randint(1, 4))) + "\n-----END RSA PRIVATE KEY-----"
                m = r.choice((code(24, both), code(40, both + "+/"), code(r.choice((8, 10, 14)), alnum.lower() + "!$%&"), word(6, 9) + digits(2), "AKIA" + code(16, alnum), "sk-" + code(32, alnum.lower()), long, long, pem, code(r.choice((128, 200, 256)))))
            elif not label and r.random() < 0.5:  # what programs and manuals assign to such names
                m = r.choice((f"{word()}({word(1, 5)})", f"${{{word().upper()}_{word().upper()}}}", f"${word().upper()}", f"{word()}.{word()}", f"{word()}.{word()}[{word(1, 4)}]", f"<your-{word()}>", f"your_{word()}", "undefined", f"os.{word()}('{word().upper()}')", f"{word()}.{word()}();", f"{{{{ {word()} }}}}", "required,", word(6, 9) + ","))
                carrier = r.choice(_CARRIERS[family][kind][0])
            if r.random() < 0.35 and not m.startswith(("eyJ", "-----")):  # in upper case, with the words before it or without
                m, carrier = m.upper(), r.choice((carrier, carrier.upper()))
        if r.random() < 0.15:
            carrier = r.choice((carrier.upper(), carrier.title()))
        before, after = carrier.split("#", 1)
        before, after = filler() + r.choice((" ", ". ", "\n", ", ")) + before, after + r.choice((" ", ".", ", ", "\n", "")) + filler()
        out += _proposed(KINDS.index(kind), before, m, after, label)
    return out


@lru_cache(maxsize=None)
def _generator(kind: int):
    import regex

    return regex.compile(GENERATORS[KINDS[kind]][0])


def _proposed(kind: int, before: str, m: str, after: str, label: int) -> list[tuple[int, str, str, str, int]]:
    """What the generator proposes where a sentence holds the example; nothing where it proposes nothing."""
    text, end, out = before + m + after, 0, []
    for f in _generator(kind).finditer(text):
        if f.start() < len(before) + len(m) and f.end() > len(before):
            out.append((kind, f.group(), text[end : f.start()][-CONTEXT:], text[f.end() :][:4], label))
        end = f.end()
    return out


def _row(kind: int, match: str, before: str, after: str) -> list[float]:
    part = {"match": match, "before": before, "after": after}
    found = [(len(re.findall(p, part[w])) if how == "n" else bool(re.search(p, part[w]))) for w, how, p in FEATURES]
    return [float(kind), float(len(match)), *map(float, found)]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold of the largest gain among rows."""
    best, gain = None, 1e-6
    G, H = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 13))):
            left = rows & (x[:, f] <= t)
            gl, hl = g[left].sum(), h[left].sum()
            if hl > 1 and H - hl > 1 and (v := gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)) > gain:
                best, gain = (f, float(t)), v
    return best


Tree = tuple  # (feature, threshold, left, right) or a number


def _grow(x, g, h, rows, depth: int, rate: float) -> Tree | float:
    if depth and rows.sum() > 40 and (s := _split(x, g, h, rows)):
        left = rows & (x[:, s[0]] <= s[1])
        return (*s, _grow(x, g, h, left, depth - 1, rate), _grow(x, g, h, rows & ~left, depth - 1, rate))
    return float(rate * g[rows].sum() / (h[rows].sum() + 1))


def _value(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _value(left, x), _value(right, x))


def _measured(family: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = examples(n, family)
    return np.array([_row(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)


@lru_cache(maxsize=1)
def model(n: int = TRAIN, rounds: int = ROUNDS, precision: float = PRECISION) -> tuple[tuple, tuple[float, ...]]:
    """Boosted trees and, for each kind, the least score that keeps the precision on the family that they weren't fitted to."""
    x, y = _measured("fit", n)
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, y - p, p * (1 - p), np.ones(len(y), bool), 3, 0.3))
        score += _value(trees[-1], x)
    x, y = _measured("calibrate", n)
    score = sum(_value(t, x) for t in trees)
    least = []
    for k in range(len(KINDS)):
        at = np.flatnonzero(x[:, 0] == k)
        order = at[np.argsort(-score[at], kind="stable")]
        ranked = score[order]
        last = np.r_[ranked[1:] < ranked[:-1], True] if len(order) else np.zeros(0, bool)  # of equal scores
        good = np.flatnonzero(last & (np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= precision))
        least.append(float(ranked[good[-1]]) if len(good) else 1e9)
    return tuple(trees), tuple(least)


def quality(family: str = "test", n: int = 4000) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind on a family of examples."""
    trees, least = model()
    x, y = _measured(family, n)
    said = sum(_value(t, x) for t in trees) >= np.array(least)[x[:, 0].astype(int)]
    return {kind: (float(y[at & said].mean()) if (at & said).any() else 1.0, float(said[at & (y == 1)].mean())) for k, kind in enumerate(KINDS) if (at := x[:, 0] == k).any()}


def _tree(tree: Tree | float) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, t, left, right = tree
    return f"CASE WHEN f[{f}] <= {t!r}D THEN {_tree(left)} ELSE {_tree(right)} END"


def _quoted(p: str) -> str:
    return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kept(kind: int, trees: tuple, least: float) -> str:
    """SQL for the candidates of the column _c whose boosted score reaches the threshold; features are worked out once a candidate."""
    part = {"match": "c.m", "before": "c.before", "after": "c.after"}
    found = [f"double(regexp_count({part[w]}, {_quoted(p)}))" if how == "n" else f"double(rlike({part[w]}, {_quoted(p)}))" for w, how, p in FEATURES]
    features = ", ".join([f"double({kind})", "double(length(c.m))", *found])
    return f"filter(_c, c -> transform(array(array({features})), f -> {' + '.join(['0.0D', *map(_tree, trees)])})[0] >= {least!r}D)"


def _luhn_ok(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn_ok(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefixes(name: str, values: str, over, join, body) -> str:
    """SQL for body(at), where at(i) joins the first i values; each costs LEVELS blocks of BLOCK values at most, and all are bound once.

    over(a) is SQL for the values of an array joined, join(parts) for what over gave joined.
    """
    levels = [f"{name}{k}" for k in range(LEVELS)]
    above = lambda v: f"transform(sequence(0, int(size({v}) div {BLOCK})), {v}_b -> {over(f'slice({v}, {v}_b * {BLOCK} + 1, {BLOCK})')})"

    def at(i: str) -> str:
        whole = lambda k: f"int(({i}) div {BLOCK**k})"
        parts = [over(f"slice({v}, {whole(k + 1)} * {BLOCK} + 1, {whole(k)} - {whole(k + 1)} * {BLOCK})") for k, v in enumerate(levels[:-1])]
        return join([over(f"slice({levels[-1]}, 1, {whole(LEVELS - 1)})"), *parts])

    out = body(at)
    for k in reversed(range(LEVELS)):
        out = _let(levels[k], above(levels[k - 1]) if k else values, out)
    return out


def _sums(name: str, values: str, body) -> str:
    """Sums of the first values."""
    total = lambda a: f"aggregate({a}, 0, (s, v) -> s + v)"
    return _prefixes(name, values, total, lambda parts: f"({' + '.join(parts)})", body)


def _highest(name: str, values: str, body) -> str:
    """Highest of the first values, null for none."""
    return _prefixes(name, values, lambda a: f"array_max({a})", lambda parts: f"greatest({', '.join(parts)})", body)


_MATCHES = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _found(pattern: str, gate: str) -> Column:
    """The pattern's matches in text in order: places (code points), the match, and the text before and after it, up to the next matches."""
    p, none = _quoted(pattern), f"cast(array() as {_MATCHES})"
    # Of gap i and the match before it; a start is a sum of the first ones.
    size = "transform(gap, (g, i) -> length(g) + if(i > 0, length(get(m, i - 1)), 0))"
    one = "named_struct('start', at, 'end', at + length(x), 'm', x, 'before', right(get(gap, i), {c}), 'after', left(get(gap, i + 1), 4))".format(c=CONTEXT)
    placed = _sums("sum", size, lambda start: f"transform(m, (x, i) -> {_let('at', start('i + 1'), one)})")
    found = _let("m", f"regexp_extract_all(text, {p}, 0)", f"if(size(m) > 0, {_let('gap', f'split(text, {p}, -1)', placed)}, {none})")
    return F.expr(f"if({gate}, {found}, {none})")


def _added(base: str, accepted: str) -> Column:
    """Spans of what accepted candidates cover outside of base spans; candidates that touch or overlap are one span, of the kind of the one that reaches furthest.

    Pieces of fewer than LEAST characters that base spans leave are dropped.
    """
    event = lambda spans, which, of: f"transform({spans}, s -> named_struct('at', s.{which}, 'base', {of}, 'end', s.end, 'kind', s.kind))"
    events = f"array_sort(concat({', '.join(event(spans, which, of) for spans, of in ((base, 'true'), (accepted, 'false')) for which in ('start', 'end'))}))"
    reach = lambda of: f"transform(events, e -> if(e.base = {of}, named_struct('end', e.end, 'kind', e.kind), null))"
    # Between two places, text is inside a candidate if one that starts before ends after them; the same goes for base spans.
    between = lambda inside, covered: f"transform(events, (e, i) -> named_struct('start', e.at, 'end', get(events, i + 1).at, 'by', {inside('i + 1')}, 'base', {covered('i + 1')}))"
    every = _highest("inside", reach("false"), lambda inside: _highest("covered", reach("true"), lambda covered: between(inside, covered)))
    parts = f"filter({every}, p -> p.end > p.start and p.by.end > p.start and not coalesce(p.base.end > p.start, false))"
    first = "filter(parts, (p, i) -> coalesce(get(parts, i - 1).end < p.start, i = 0))"
    last = "filter(parts, (p, i) -> coalesce(get(parts, i + 1).start > p.end, true))"
    merged = f"filter(zip_with({first}, {last}, (a, b) -> named_struct('kind', a.by.kind, 'start', a.start, 'end', b.end)), s -> s.end - s.start >= {LEAST})"
    found = _let("events", events, _let("parts", parts, merged))
    return F.expr(f"if(size({accepted}) > 0, {found}, cast(array() as {_SPANS}))")


def _with_spans(documents: DataFrame, text_col: str) -> DataFrame:
    """Adds base (sorted base spans) and added (of accepted candidates), arrays of struct(kind, start, end)."""
    df = documents.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    spans = lambda found, k: F.transform(found, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    passing = lambda found, kind: F.filter(found, lambda s: _passes(kind, s["m"]))
    gated = {kind: "contains(text, '@')" if kind == "email" else f"rlike(text, {_quoted(gate)})" for kind, gate in _GATE.items()}
    df = df.withColumn("base", F.array_sort(F.concat(*(spans(passing(_found(BASE_PATTERNS[kind], gated[kind]), kind), k) for k, kind in enumerate(BASE)))))
    trees, least = model()
    for kind, (pattern, gate) in GENERATORS.items():
        k = KINDS.index(kind)
        df = df.withColumn("_c", _found(pattern, f"rlike(text, {_quoted(gate)})")).withColumn(f"_{kind}", F.expr(_kept(k, trees, least[k])))
    df = df.withColumn("_accepted", F.concat(*(spans(f"_{kind}", KINDS.index(kind)) for kind in GENERATORS)))
    return df.withColumn("added", _added("base", "_accepted")).drop("_c", "_accepted", *(f"_{kind}" for kind in GENERATORS))


def _joined(spans: Column | str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of base spans by kind, base_sha256, spans, n_added."""
    df = _with_spans(documents.select(id_col, F.col(text_col).alias("text")), "text")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return df.select(id_col, *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are replaced once. Null texts stay null."""
    columns = documents.columns
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    df = _with_spans(packed, "text")
    order = "array_sort(transform(concat(base, added), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    # Spans that start after all before them have ended, with the highest end before: what stands between is kept, cut from the chunks that hold it.
    marked = _highest("before", "transform(spans, s -> s.end)", lambda before: f"transform(spans, (s, i) -> named_struct('start', s.start, 'kind', s.kind, 'before', {before('i')}))")
    free = f"filter({marked}, s -> coalesce(s.start >= s.before, true))"
    held = lambda a, b: f"array_join(slice(chunks, int(({a}) div {CHUNK}) + 1, int((({b}) - 1) div {CHUNK}) - int(({a}) div {CHUNK}) + 1), '')"
    cut = lambda a, b: f"if({b} > {a}, substring({held(a, b)}, ({a}) % {CHUNK} + 1, ({b}) - ({a})), '')"
    names = f"array({', '.join(f"'[{k.upper()}]'" for k in KINDS)})"
    out = f"concat(array_join(transform(free, s -> concat({cut('coalesce(s.before, 0)', 's.start')}, get({names}, s.kind))), ''), {cut('array_max(transform(spans, s -> s.end))', 'length(text)')})"
    chunks = f"regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0)"
    whole = F.expr(_let("spans", order, _let("free", free, _let("chunks", chunks, out))))
    clean = F.when(F.col("row")[text_col].isNull(), F.lit(None).cast("string")).when(F.size("base") + F.size("added") > 0, whole).otherwise(F.col("text"))
    return df.withColumn("_clean", clean).select(*(F.col("_clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns))
