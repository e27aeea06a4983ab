"""A semi-Markov conditional random field over tokens: whole-span features score candidate segments, and one dynamic
programme over bounded segments chooses boundaries and types together."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
#: Tokens of a phone, of an account and of a part of a secret (a whole run of its characters may be longer), and tokens
#: of context on both sides of a segment. No phone or account that `_MAYBE` accepts has more tokens.
LONGEST, CONTEXT = {"local_phone": 23, "account": 17, "secret": 23}, 6
#: Characters of an e-mail address before its at and after it, joins counted as one: more are no address (RFC 5321).
LOCAL, DOMAIN = 64, 253
TYPES = ("written_email", "local_phone", "account", "secret")
_CUES = {
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "api", "bearer", "pwd"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "telefon", "telephone", "móvil", "teléfono", "téléphone", "anruf"},
    "account": {"iban", "account", "konto", "compte", "cuenta", "bank"},
    "mail": {"mail", "email", "contact", "write", "kontakt", "contacto", "correo"},
    "count": {"isbn", "issn", "version", "page", "pages", "vol", "volume", "year", "years", "license", "chapter", "section", "doi", "id", "no", "nr", "order", "score"},
}
_MAYBE = {
    "written_email": re.compile(r"[A-Za-z0-9._%+-]+\s*[\[(]\s*(?:at|AT|@)\s*[\])]\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]\s*(?:dot|DOT|\.)\s*[\])])\s*[A-Za-z0-9-]+)+"),
    "local_phone": re.compile(r"\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
    "secret": re.compile(r"[A-Za-z0-9_-]{16,}"),
}
#: What an island has to hold for any segment to be possible: six digits in reach, a bracketed at, the beginning of an
#: account, or a long run of a secret's characters with a digit. A run is read once, as a whole.
HOT = re.compile(r"(?:[0-9][ ().\-/]{0,4}){6}|[\[(]\s*(?:at|AT|@)\s*[\])]|(?<![^\W_])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
_RUN = re.compile(r"[A-Za-z0-9_-]{16,}+")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"[\[(]\s*(?:at|AT|@)\s*[\])]")
_DOT = re.compile(r"[\[(]\s*(?:dot|DOT|\.)\s*[\])]")
_MORE = re.compile(r"\s*[\[(]\s*(?:dot|DOT|\.)\s*[\])]|\.?[A-Za-z0-9-]")
_NAME = re.compile(r"\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]\s*(?:dot|DOT|\.)\s*[\])])\s*[A-Za-z0-9-]+)*")
#: Tokens that a segment of a kind may hold, and those that it may begin with.
_INSIDE = {"local_phone": re.compile(r"[0-9]{1,5}| {1,2}|[()./-]"), "account": re.compile(r" |[A-Z0-9]+"), "secret": re.compile(r"[A-Za-z0-9]+|[_-]")}
_FIRST = {"local_phone": re.compile(r"[0-9(]"), "account": re.compile(r"[A-Z]{2}[0-9]{2}"), "secret": re.compile(r"[A-Za-z0-9_-]")}
_LOCAL, _LABEL = re.compile(r"[A-Za-z0-9]+|[._%+-]"), re.compile(r"[A-Za-z0-9]+|-")


def _iban(x: str) -> bool:
    x = x.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _entropy(x: str) -> float:
    counts = [x.count(c) / len(x) for c in set(x)]
    return -sum(p * math.log2(p) for p in counts)


def possible(kind: str, span: str) -> bool:
    """Whether a segment may have a type at all; others score minus infinity."""
    if not _MAYBE[kind].fullmatch(span):
        return False
    digits = sum(c.isdigit() for c in span)
    if kind == "local_phone":
        return 7 <= digits <= 15 and span.count("(") == span.count(")")
    return kind != "secret" or (0 < digits < len(span))


def span_features(kind: str, span: str, left: list[str], right: list[str]) -> list[str]:
    """Names of the features that hold for a whole segment and its context."""
    digits = sum(c.isdigit() for c in span)
    words = {x.lower() for x in left}
    out = ["bias", f"digits{min(digits, 16) // 2}", f"size{min(len(span), 48) // 6}"]
    out += [f"cue_{name}" for name, cues in _CUES.items() if words & cues]
    before, after = (left[-1] if left else " "), (right[0] if right else " ")
    out.append("open" if before.isspace() or before in "\"'(=:" else "tied_left")
    out.append("closed" if after.isspace() or after in "\"').,;:!?" else "tied_right")
    if before in "\"'" and before == after:
        out.append("quoted")
    if kind == "secret":
        out += [f"entropy{int(2 * _entropy(span))}"] + ["hex"] * bool(re.fullmatch("[0-9a-f]{32,}", span)) + ["share" + str(int(4 * digits / len(span)))]
        out += ["switches" + str(min(6, len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", span)) // 2))]
    elif kind == "written_email":
        out.append("goes_on" if _MORE.match("".join(right)) else "ends")
    elif kind == "account":
        out.append("sum_holds" if _iban(span) else "sum_fails")
    elif kind == "local_phone":
        out += ["shape" + re.sub("[0-9]+", lambda m: str(len(m[0])), span), "bracket" if "(" in span else "no_bracket", "date" if re.match(r"(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.]|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}|(19|20)[0-9]{2} ?- ?(19|20)[0-9]{2}$", span) else "no_date"]
    return [f"{kind}:{x}" for x in out]


@dataclass(frozen=True)
class Segment:
    start: int  # in tokens
    end: int
    kind: str
    features: tuple[str, ...]


def _bracketed(mark: re.Pattern, tokens: list[str], at: int) -> int:
    """Where a mark in brackets that begins at a token ends, or 0."""
    for n in (3, 4, 5):  # the mark, with or without white space on either side
        if mark.fullmatch("".join(tokens[at : at + n])):
            return min(at + n, len(tokens))
    return 0


def _mails(tokens: list[str], shut: list[bool]) -> list[tuple[int, int]]:
    """(start, end) of all written-out addresses, of any number of tokens, by walking both ways from each at."""
    found = []
    for i, x in enumerate(tokens):
        if x not in "[(" or not (k := _bracketed(_AT, tokens, i)) or any(shut[i:k]):
            continue
        starts, at, size = [], i - 1, 0
        if at >= 0 and tokens[at].isspace() and not shut[at]:
            at -= 1
        while at >= 0 and not shut[at] and _LOCAL.fullmatch(tokens[at]) and (size := size + len(tokens[at])) <= LOCAL:
            starts.append(at)
            at -= 1
        ends, joins, size, n = [], 0, 0, len(tokens)
        while starts:
            if k < n and tokens[k].isspace() and not shut[k]:
                k += 1
            if not (k < n and not shut[k] and _LABEL.fullmatch(tokens[k])):
                break
            while k < n and not shut[k] and _LABEL.fullmatch(tokens[k]) and (size := size + len(tokens[k])) <= DOMAIN:
                k += 1
                if joins:
                    ends.append(k)
            if k < n and tokens[k].isspace() and not shut[k]:
                k += 1
            after = k + 1 if k < n and tokens[k] == "." else _bracketed(_DOT, tokens, k) if k < n and tokens[k] in "[(" else 0
            if not after or any(shut[k:after]) or (size := size + 1) > DOMAIN:
                break
            k, joins = after, joins + 1
        found += [(s, e) for s in starts for e in ends]
    return found


def segments(tokens: list[str], blocked: list[bool] | None = None) -> list[Segment]:
    """Every possible segment of an island, with its features. No segment covers a blocked token.

    Phones, accounts and addresses are bounded by nothing but their own form. A run of a secret's characters may be a
    segment whole, however long it is, and so may every part of it of at most ``LONGEST`` tokens."""
    shut = [x or "\n" in t for x, t in zip(blocked or [False] * len(tokens), tokens, strict=True)]
    spans = [(i, j, "written_email") for i, j in _mails(tokens, shut)]
    for kind, longest in LONGEST.items():
        first, inside = _FIRST[kind], _INSIDE[kind]
        run = 0  # end of the run of a secret's characters that holds the token
        for i in range(len(tokens)):
            if shut[i] or not first.match(tokens[i]):
                continue
            j, last = i, min(len(tokens), i + longest)
            while j < last and not shut[j] and inside.fullmatch(tokens[j]):
                j += 1
                if possible(kind, "".join(tokens[i:j])):
                    spans.append((i, j, kind))
            if kind == "secret" and i >= run:
                run = max(j, i + 1)
                while j > i and run < len(tokens) and not shut[run] and inside.fullmatch(tokens[run]):
                    run += 1
                if run - i > longest and possible(kind, "".join(tokens[i:run])):
                    spans.append((i, run, kind))
    spans.sort(key=lambda s: (s[0], s[1], TYPES.index(s[2])))
    return [Segment(i, j, kind, tuple(span_features(kind, "".join(tokens[i:j]), tokens[max(0, i - CONTEXT) : i], tokens[j : j + CONTEXT]))) for i, j, kind in spans]


def score(segment: Segment, weights: dict[str, float]) -> float:
    return sum(weights.get(x, 0.0) for x in segment.features)


def decode(n: int, found: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The segmentation of highest score; tokens outside segments score nothing."""
    ending: dict[int, list[Segment]] = {}
    for s in found:
        ending.setdefault(s.end, []).append(s)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for at in range(1, n + 1):
        best[at] = best[at - 1]
        for s in ending.get(at, ()):
            if (value := best[s.start] + score(s, weights)) > best[at]:
                best[at], back[at] = value, s
    out, at = [], n
    while at > 0:
        if back[at] is None:
            at -= 1
        else:
            out.append(back[at])
            at = back[at].start
    return out[::-1]


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expected(n: int, found: list[Segment], weights: dict[str, float]) -> tuple[float, list[float]]:
    """Log of the partition function, and the marginal probability of each segment, by forward and backward sums."""
    scores = [score(s, weights) for s in found]
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for i, s in enumerate(found):
        ending.setdefault(s.end, []).append(i)
        starting.setdefault(s.start, []).append(i)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for at in range(1, n + 1):
        ahead[at] = _sum([ahead[at - 1], *(ahead[found[i].start] + scores[i] for i in ending.get(at, ()))])
    for at in range(n - 1, -1, -1):
        behind[at] = _sum([behind[at + 1], *(behind[found[i].end] + scores[i] for i in starting.get(at, ()))])
    return ahead[n], [math.exp(ahead[s.start] + scores[i] + behind[s.end] - ahead[n]) for i, s in enumerate(found)]


def train(examples: list[tuple[int, list[Segment], set[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.3, decay: float = 0.002) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood, with per-weight steps."""
    weights: dict[str, float] = {}
    square: dict[str, float] = {}
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(examples)
        for n, found, gold in examples:
            if not found:
                continue
            _, marginal = expected(n, found, weights)
            step: dict[str, float] = {}
            for s, m in zip(found, marginal, strict=True):
                by = float((s.start, s.end, s.kind) in gold) - m
                if abs(by) > 1e-4:
                    for x in s.features:
                        step[x] = step.get(x, 0.0) + by
            for x, g in step.items():
                g -= decay * weights.get(x, 0.0)
                square[x] = square.get(x, 1e-3) + g * g
                weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(square[x])
    return weights


def examples(n: int = 260, seed: int = 11) -> list[tuple[str, list[tuple[str, str]]]]:
    """Made-up texts with their spans (kind, span): the field's training rows, half of them without any."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["tion", "er", "an", "the", "in", "ou", "re", "st", "é", "ch"]) for _ in range(r.randint(1, 4)))
    some = lambda k: " ".join(word() for _ in range(k))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def iban() -> str:
        country, size = r.choice([("DE", 18), ("DE", 18), ("MT", 27)])
        body = num(size)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{check:02d}{body}"

    def wrong() -> str:
        x = iban()
        return x[:2] + f"{(int(x[2:4]) + 1) % 100:02d}" + x[4:]

    phones = [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(3)} {num(3)} {num(4)}", lambda: f"0{num(2)}/{num(7)[:5]}"]
    secrets = [lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), lambda: "".join(r.choice("0123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.randint(20, 40))), lambda: "-".join("".join(r.choice("0123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ_") for _ in range(r.randint(4, 20))) + num(1) for _ in range(r.randint(4, 24)))]
    plain = [lambda: f"{num(4)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}/0{r.randint(1, 9)}/20{num(2)}", lambda: f"{num(16)}", lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"19{num(2)}-20{num(2)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"{num(2)} {num(3)} {num(3)}", lambda: f"{num(1)}. {word()}{num(2)}", lambda: word() + "-" + word() + "-" + word() + "-" + num(2), lambda: f"page {num(3)}-{num(4)}", wrong, lambda: word() * 6 + num(1)]
    out = []
    for i in range(n):
        spans: list[tuple[str, str]] = []
        if i % 2:
            kind = r.choice(TYPES)
            if kind == "secret":
                x = r.choice(secrets)()
                cue = r.choice(['token = "{}"', "key: {}", "api key {} ", "secret={}", 'token = "{}"!!', "password {}"])
            elif kind == "local_phone":
                x, cue = r.choice(phones)(), r.choice(["call {}", "tel. {}", "phone: {}", "fax {}", "{}"])
                cue = cue if "(" in x or cue != "{}" else "tel {}"
            elif kind == "account":
                x = iban()
                x = x if r.random() < 0.5 else " ".join(x[k : k + 4] for k in range(0, len(x), 4))
                cue = r.choice(["iban {}", "{}", "account {}"])
            else:
                x = r.choice(["{}.{} (at) {}.com", "{}{} [at] {} [dot] org", "{}_{}(at){}.net", "{}.{} [at] {} [dot] com", "{}.{} (at) {}.{}.co.uk", "{} [at] {} [dot] {} [dot] org", "{}.{}.{} [at] {} [dot] {} [dot] co [dot] uk"]).format(*(r.choice(["anna", "jo", "max", "lee", "kim", "mail7", "inbox"]) for _ in range(5)))
                x, cue = x.replace("_", "-"), r.choice(["{}", "mail {}", "write to {}"])
            text = f"{some(r.randint(1, 5))} {cue.format(x)} {some(r.randint(1, 5))}"
            spans.append((kind, x))
        else:
            text = f"{some(r.randint(1, 5))} {r.choice(plain)()} {some(r.randint(1, 5))}"
        out.append((text, spans))
    return out


def prepared(rows: list[tuple[str, list[tuple[str, str]]]]) -> list[tuple[int, list[Segment], set[tuple[int, int, str]]]]:
    out = []
    for text, spans in rows:
        tokens = TOKEN.findall(text)
        places, at = {}, 0
        for i, x in enumerate(tokens):
            places[at] = i
            at += len(x)
        places[at] = len(tokens)
        gold = {(places[text.index(x)], places[text.index(x) + len(x)], kind) for kind, x in spans}
        out.append((len(tokens), segments(tokens), gold))
    return out


_trained: dict[str, float] = {}


def trained() -> dict[str, float]:
    """Weights fitted on `examples`, once in a process."""
    if not _trained:
        _trained.update(train(prepared(examples())))
    return _trained


def extra_spans(text: str, blocked: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the field's spans in a text, none of which touches a blocked range.

    A token in no possible segment is outside in every segmentation, so the best segmentation of a text is that of its
    islands, stretches around hot places wide enough for the longest segment there and its context."""
    reach = 160
    islands: list[list[int]] = []
    hot = [m.span() for m in HOT.finditer(text)] + [m.span() for m in _RUN.finditer(text) if _DIGIT.search(text, *m.span())]
    for a, b in sorted(hot):
        if text[a] in "[(" and _AT.match(text, a):  # an address may be longer than the reach
            while a > 0 and text[a - 1].isspace():
                a -= 1
            a -= min(a, LOCAL)
            b = whole.end() if (whole := _NAME.match(text, b)) else b
        a, b = max(0, a - reach), min(len(text), b + reach)
        if islands and a <= islands[-1][1]:
            islands[-1][1] = max(b, islands[-1][1])
        else:
            islands.append([a, b])
    out, k = [], 0
    blocked = sorted(blocked)
    for a, b in islands:
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        tokens = TOKEN.findall(text[a:b])
        starts, at = [], a
        for x in tokens:
            starts.append(at)
            at += len(x)
        starts.append(at)
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        shut, q = [False] * len(tokens), k
        for i in range(len(tokens)):
            while q < len(blocked) and blocked[q][1] <= starts[i]:
                q += 1
            shut[i] = q < len(blocked) and blocked[q][0] < starts[i + 1]
        for s in decode(len(tokens), segments(tokens, shut), weights):
            span = (starts[s.start], starts[s.end], s.kind)
            if not out or span[0] >= out[-1][1]:
                out.append(span)
    return out
