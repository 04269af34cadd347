"""Problem 9: sentence units across languages and scripts.

Every character of a text is tagged boundary or inside by a linear-chain model decoded
with Viterbi. A character can only be a boundary where an end mark, a closing quote or
bracket, a line end or, in scripts written without end marks, a space allows one; all
others have the tag inside, so the chain is decoded over these candidates. What stands
inside an open quotation or bracket, or a list line, is no candidate.

A candidate is described by its context alone: the mark, the kind of the token before it
(known or learned abbreviation, initial, number, word ..), the characters beside it, the
case and commonness of the next word, whether a quotation opened the unit. Emission features
are parts and conjunctions of that description; transitions tie neighbours together. The
weights are a structured averaged perceptron, trained on
  - a bounded sample of the documents, every script with its share: contexts that decide
    themselves (`obvious`); others have no label there,
  - hand-labelled texts (labelled_texts) for the contexts that do not,
  - unpunctuated scripts (Thai, Lao, Khmer, Burmese): the sampled texts with their end
    marks stripped, so that the letters before a boundary carry it; where a mark was
    taken away is a boundary.
Abbreviations that are in no list (tokens whose point is mostly followed by a small letter
or a digit), words common in running text and the endings of unpunctuated sentences are
counted over all documents.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corvane.llm.common import spread
from corvane.llm.labelled_texts import LABELLED

#: Bound of the sample the weights are trained on, the only use of less than all documents.
SAMPLE_DOCS = 1500
#: Different words a task counts before it passes its counts on.
TALLY_WORDS = 200_000
EPOCHS = 6
#: Contexts whose emission a task keeps.
KNOWN = 200_000
#: How often the hand-labelled texts are shown in an epoch.
SHOWN = 8

# Abbreviations that a sentence does not end with, and those it can end with.
NEVER = frozenset(
    "dr prof mr mrs ms st mt rev hon gen col lt capt sgt no nos vol fig figs cf e.g i.e eg ie approx incl vs viz al pp p.p ed eds jan feb mar apr jun jul aug sep sept oct nov dec "
    "hr hrn fr nr bzw ca z.b d.h vgl evtl ggf inkl bspw geb str abs art s z d "
    "sr sra srta sres dra núm pág págs ej p.ej aprox ee av avda "
    "m mme mlle mm env p.ex ex n p chap tél "
    "г-н им ул рис стр см ок гл т.е т.к руб тыс млн млрд д-р проф "
    "डॉ श्री सं د أ م".split()
)
CAN_END = frozenset("etc usw u.a inc ltd co corp jr a.m p.m am pm u.s e.u u.s.a u.k uu т.д т.п д п др г гг в вв min max".split())
ORDINAL_BEFORE = frozenset("der die das den dem des am im zum zur beim vom bis ab ein eine einen einem mein meine ihr ihre sein seine jeder jede jeden".split())

HARD = "。！？।॥؟｡⁇⁈⁉！？᙮።"
_EVENT = re.compile(r"\s*\n\s*|[(（\[【「『“«„‘‹<>›\])）】」』”»’\"]|[.!?…⋯" + HARD + "]+")
_EVENT_TH = re.compile(_EVENT.pattern + r"|(?<=[฀-๿຀-໿က-႟ក-៿])[ \t ]+|[ \t ]+(?=[฀-๿຀-໿က-႟ក-៿])")
_UNPUNCTUATED = re.compile("[฀-๿຀-໿က-႟ក-៿]")
# Scripts that share the training sample, the first that a text holds is its own; others are one more.
SCRIPTS = ("[฀-๿]", "[຀-໿]", "[က-႟]", "[ក-៿]", "[\u0900-\u097f]", "[\u0600-\u06ff]", "[\u3040-\u30ff]", "[\uac00-\ud7af]", "[\u3400-\u9fff]", "[\u0400-\u04ff]", "[\u0370-\u03ff]")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“”", "‘": "’", "‹": "›"}
_CLOSERS = frozenset(")）]】」』”»’›\"“")
_BRACKETS = frozenset("(（[【")
_SYMBOL = re.compile("(?:[ \t ]*(?:\n(?!\\s*\n))?[ \t ]*[\U0001F000-\U0001FAFF☀-➿⬀-⯿⌀-⏿][️‍\U0001F3FB-\U0001F3FF]*)+")
_LIST = re.compile(r"[ \t]*(?:[-*•·–—▪◦‣]|\d{1,3}[.)]|[a-zA-Z][.)]|[(（]\d{1,3}[)）])[ \t]+(?=\S)")
_TOKEN_BEFORE = re.compile(r"[^\s()（）\"“”«»„‘’\[\]/—–-]{1,24}$")
_TIGHT = re.compile(r"(?<=[^\W\dA-ZÀ-ÞА-Я_])[.!?…]+(?=[A-ZÀ-ÞА-Я])")
_WORD_AFTER = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯ｦ-ﾟ]")


def _list_lines(text: str) -> tuple[set[int], list[tuple[int, int]]]:
    """(starts of list lines, spans of list lines), where a list follows a line that ends with a colon, or opens its block and has two lines or more."""
    starts: set[int] = set()
    spans: list[tuple[int, int]] = []
    if "\n" not in text:
        return starts, spans
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    inside, k = False, 0
    before = ""
    while k < len(lines):
        at, line = lines[k]
        if not line.strip():
            inside = False
            k += 1
            continue
        if _LIST.match(line):
            opens_block = k == 0 or not lines[k - 1][1].strip()
            follows = k + 1 < len(lines) and _LIST.match(lines[k + 1][1])
            if inside or before.rstrip().endswith((":", "：")) or opens_block and follows:
                starts.add(at)
                spans.append((at, at + len(line)))
                inside = True
        elif inside:
            spans[-1] = (spans[-1][0], at + len(line))
        before = line
        k += 1
    return starts, spans


class Stats:
    """What all documents tell: abbreviations, words common in running text, and the endings of unpunctuated sentences."""

    def __init__(self, abbreviations=frozenset(), common=frozenset(), endings=frozenset()):
        self.abbreviations, self.common, self.endings = abbreviations, common, endings


def _class(c: str) -> str:
    if not c:
        return "e"
    if c.isupper():
        return "U"
    if c.islower():
        return "l"
    if c.isdigit():
        return "d"
    if c.isalpha():
        return "a"
    return c if c in ",;:—–-、，；：" else "o"


Context = tuple


def candidates(text: str, stats: Stats) -> list[tuple[int, Context]]:
    """[(end of the unit if this is a boundary, context)]."""
    out: list[tuple[int, Context]] = []
    starts, spans = _list_lines(text)
    spans.append((len(text) + 1, len(text) + 1))
    span = 0
    stack: list[tuple[str, bool]] = []
    begin = 0  # end of the last candidate at which a unit may end
    skip = 0
    thai = bool(_UNPUNCTUATED.search(text))
    n = len(text)

    def propose(end: int, context: Context) -> None:
        nonlocal begin
        out.append((end, context))
        if obvious(context):
            begin = end

    for m in (_EVENT_TH if thai else _EVENT).finditer(text):
        a, b = m.span()
        if a < skip:
            continue
        piece = m[0]
        c = piece[0]
        while spans[span][1] <= a:
            span += 1
        in_list = spans[span][0] <= a < spans[span][1]
        if c.isspace():
            if "\n" in piece:
                if a == 0 or b == n:
                    continue
                if piece.count("\n") > 1 or "\r" in piece and piece.replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1:
                    stack.clear()
                    propose(a, ("n", "blank", ""))
                elif (b - len(_indent(piece))) in starts or b in starts:
                    stack.clear()
                    propose(a, ("n", "list", ""))
                else:
                    propose(a, ("n", "wrap", _class(text[a - 1])))
            elif not stack and not in_list and a > 0 and b < n:
                propose(a, ("t", text[max(0, a - 4) : a], text[max(0, a - 3) : a] in stats.endings))
            continue
        if c in '"' or c in _PAIRS or c in _CLOSERS:
            if stack and (c in stack[-1][0]) and not (c == "’" and text[b : b + 1].isalpha()):
                closer, at_start = stack.pop()
                if stack or in_list:
                    continue
                inner = text[:a].rstrip()[-1:] if text[a - 1].isspace() else text[a - 1]
                if inner and (inner in ".!?…⋯" or inner in HARD):
                    end = b
                    while end < n and text[end] in _CLOSERS and text[end] not in '"“':
                        end += 1
                    end, nxt, word = _ahead(text, end)
                    carrier = text[b : b + 1] in ("と", "っ")
                    propose(end, ("c", "b" if closer in ")）]】" else "q", "h" if inner in HARD else inner, at_start, "," if carrier else _class(nxt), word in stats.common))
                    skip = max(skip, end)
                continue
            if c == '"' or c in _PAIRS:
                closer = '"' if c == '"' else _PAIRS[c]
                stop = text.find("\n\n", b)
                stop = n if stop < 0 else stop
                close = max(text.find(x, b, stop) for x in closer)
                again = text.find(c, b, stop) if c in _BRACKETS else -1
                # a bracket that opens again before it closes was left open
                if close >= 0 and not 0 <= again < close:
                    stack.append((closer, not text[begin:a].strip()))
            continue
        if stack or in_list or c in "<>":
            continue
        end = b
        while end < n and text[end] in _CLOSERS and text[end] not in '"“':
            end += 1
        tight = end < n and not text[end].isspace()
        end, nxt, word = _ahead(text, end)
        k = _class(nxt)
        prev = text[a - 1 : a]
        if k == "e":
            continue  # the text ends here anyway
        if any(x in HARD for x in piece):
            mark = "h"
        elif piece[0] in "…⋯" or piece.startswith(".."):
            mark = "x" if "!" in piece or "?" in piece else "…"
        else:
            mark = "!" if "!" in piece or "?" in piece else "."
        cjk = bool(_CJK.match(prev) or _CJK.match(nxt))
        kind, before, token = _kind(text, a, stats) if mark == "." else ("", "", "")
        shape = ""
        if tight:
            after = text[b : b + 3]
            shape = "url" if _url(text, a) else "Aa" if after[:1].isupper() and (after[1:2].islower() or after[1:2] in " '’") else "A" if after[:1].isupper() else _class(after[:1])
        propose(end, ("e", mark, kind, k, tight, word in stats.common, before, shape, cjk, token))
        skip = max(skip, end)
    return out


def _indent(piece: str) -> str:
    return piece[len(piece.rstrip(" \t")) :]


def _ahead(text: str, end: int) -> tuple[int, str, str]:
    """Past symbols that belong to the unit; the next visible character and word."""
    m = _SYMBOL.match(text, end)
    if m:
        end = m.end()
    k = end
    while k < len(text) and text[k].isspace():
        k += 1
    nxt = text[k : k + 1]
    while nxt and nxt in "¿¡\"'“«„‘(（「『—–":
        if nxt in "—–":
            break
        k += 1
        nxt = text[k : k + 1]
    w = _WORD_AFTER.match(text, k)
    return end, nxt, w[0].casefold() if w else ""


def _token(text: str, a: int) -> str:
    """The token that ends at a; of "ends.Then" only what follows the mark."""
    m = _TOKEN_BEFORE.search(text[max(0, a - 24) : a])
    return _TIGHT.split(m[0])[-1] if m else ""


def _url(text: str, a: int) -> bool:
    token = text[: a].split()[-1:] if a < 200 else text[a - 200 : a].split()[-1:]
    return bool(token) and ("/" in token[0] or "@" in token[0])


def _kind(text: str, a: int, stats: Stats) -> tuple[str, str, str]:
    """(kind of the token before a point, whether the word before it calls for an ordinal or the point for a year, short tokens themselves)."""
    token = _token(text, a)
    low = token.casefold().lstrip(".")
    short = low if len(low) < 6 else ""
    if not low:
        return "none", "", ""
    if low.replace(".", "").isdigit():
        before = text[max(0, a - len(token) - 16) : a - len(token)].split()
        return ("day" if token.isdigit() and len(token) < 3 else "number"), "o" if before and before[-1].casefold() in ORDINAL_BEFORE else "", ""
    if low in ("г", "гг"):
        return "year", "d" if text[max(0, a - len(token) - 6) : a - len(token)].strip()[-1:].isdigit() else "", short
    if low in CAN_END:
        return "canend", "", short
    if low in NEVER:
        return "never", "", short
    if len(low) == 1 and token.isupper():
        return ("pronoun" if token == "I" and text[a - 3 : a - 2].islower() else "initial"), "", ""
    if _DOTTED.fullmatch(token):
        return "letters", "", ""
    if low in stats.abbreviations:
        return "learned", "", ""
    if len(low) <= 2 and low.isalpha() and low not in stats.common:
        return "short", "", ""
    last = token[-1:]
    return "word" if last.islower() or last.isdigit() or len(token) > 3 and token.isalpha() else "other", "", ""


def obvious(context: Context) -> int:
    """1 or 0 where the context decides by itself whether a unit ends, else -1: the weak labels of unlabelled texts."""
    if context[0] == "n":
        return int(context[1] != "wrap")
    if context[0] == "t":
        return int(context[2]) if context[1][-1:] and _UNPUNCTUATED.match(context[1][-1]) else 0
    if context[0] == "c":
        return 0 if context[4] in _GOES_ON else -1
    _, mark, kind, k, tight, common, _, shape, cjk, _ = context
    if k in _GOES_ON:
        return -1 if k == "—" else 0
    if mark == "h":
        return 1
    if mark == "!":
        return 0 if shape in ("url", "d") else 1
    if mark in "x…":
        return 1 if cjk or mark == "x" or k == "U" and not tight else -1
    if kind in ("never", "initial") and not tight:
        return 0
    if tight:
        return 0 if shape in ("url", "d", "l") else -1
    return 1 if kind == "word" and k == "U" else -1


_GOES_ON = ",;:—–-、，；："
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")


def features(context: Context) -> list[str]:
    """Parts and conjunctions of a context."""
    if context[0] == "n":
        return [f"n:{context[1]}", f"n:{context[1]}:{context[2]}"]
    if context[0] == "t":
        left = context[1]
        return ["th", f"th:{context[2]}", f"s2:{left[-2:]}", f"s3:{left[-3:]}", f"s4:{left}", f"c:{_letter_class(left[-1:])}"]
    if context[0] == "c":
        _, kind, inner, start, k, common = context
        on = k in _GOES_ON
        return [f"c:{kind}", f"c:{kind}:{k}", f"c:{kind}:{int(start)}:{k}", f"c:{kind}:{int(start)}:{k}:{int(common)}", f"c:{kind}:{int(start)}", f"c:on:{int(on)}", f"c:{kind}:{inner}:{k}:{int(start)}"]
    _, mark, kind, k, tight, common, before, shape, cjk, token = context
    near = f"{k}:{int(tight)}{shape}"
    out = [f"e:{mark}", f"e:{mark}:{near}", f"e:{mark}:{kind}", f"e:{mark}:{kind}:{near}", f"e:{mark}:{kind}:{near}:{int(common)}{before}", f"e:{mark}:{int(cjk)}:{near}", f"e:on:{int(k in _GOES_ON)}", f"e:{mark}:{k}:{int(common)}"]
    if token:
        out += [f"tok:{token}", f"tok:{token}:{k}"]
    return out


def _letter_class(c: str) -> str:
    return "t" if c and _UNPUNCTUATED.match(c) else _class(c)


_POINT = re.compile(r"(?<!\S)([^\W\d_]{1,8}(?:\.[^\W\d_]{1,3})*)\. (\S)")
_RUNNING = re.compile(r"(?<=[^\W\d_,] )([^\W\d_]+)")
_MARKS = re.compile(r"(?<=[฀-๿຀-໿က-႟ក-៿])[ ]?[.!?…]+(?=\s|$)")


class Tally:
    """Counts that are summed over documents: (kind, key) has how often it is so and how often it is not."""

    def __init__(self):
        self.yes = {"point": Counter(), "word": Counter(), "ending": Counter()}
        self.no = {"point": Counter(), "word": Counter(), "ending": Counter()}

    def add(self, text: str) -> None:
        for token, nxt in _POINT.findall(text):
            (self.yes if nxt.islower() or nxt.isdigit() else self.no)["point"][token.casefold()] += 1
        for w in _RUNNING.findall(text):
            if w.islower():
                self.yes["word"][w] += 1
            elif len(w) > 1:
                self.no["word"][w.casefold()] += 1  # names are mostly written with capitals, however many texts there are
        if _UNPUNCTUATED.search(text):
            self._endings(text)

    def _endings(self, text: str) -> None:
        """Three letters that stand before a known end (a mark taken away, the end of a block), and inside words."""
        for block in re.split(r"\s*\n\s*\n\s*", text):
            if not _MARKS.search(block) and len(block) < 40:
                continue  # a heading says nothing about how sentences end
            for part in _MARKS.split(block):
                part = part.strip()
                if len(part) > 3 and _UNPUNCTUATED.match(part[-1]):
                    self.yes["ending"][part[-3:]] += 1
                    self.no["ending"].update(part[k - 3 : k] for k in range(3, len(part)) if _UNPUNCTUATED.match(part[k]) and _UNPUNCTUATED.match(part[k - 1]))

    def size(self) -> int:
        return sum(len(c) for part in (self.yes, self.no) for c in part.values())

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        for kind, yes in self.yes.items():
            no = self.no[kind]
            for key in yes.keys() | no.keys():
                yield kind, key, yes[key], no[key]


def _kept(kind: str, yes: int, no: int) -> bool:
    """The rule of each kind; `_KEPT` is the same as SQL."""
    return yes + no >= 5 and yes > no if kind == "point" else yes >= 5 and yes > no if kind == "word" else yes >= 2 and yes > no


_KEPT = "case kind when 'point' then yes + no >= 5 and yes > no when 'word' then yes >= 5 and yes > no else yes >= 2 and yes > no end"


def _stats(rows) -> Stats:
    found: dict[str, set[str]] = {"point": set(), "word": set(), "ending": set()}
    for kind, key, *_ in rows:
        found[kind].add(key)
    return Stats(*(frozenset(x) for x in found.values()))


def learn_words(texts: list[str]) -> Stats:
    tally = Tally()
    for t in texts:
        tally.add(t)
    return _stats(r for r in tally.rows() if _kept(r[0], r[2], r[3]))


def learn_table(texts: DataFrame) -> Stats:
    """`learn_words` over all rows of (text): counted by task, summed by key; only what is kept is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tally: Tally) -> pa.RecordBatch:
            kinds, keys, yes, no = zip(*tally.rows()) if tally.size() else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(yes, pa.int64()), pa.array(no, pa.int64())], ["kind", "key", "yes", "no"])

        tally = Tally()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.add(text)
            if tally.size() > TALLY_WORDS:
                yield flush(tally)
                tally = Tally()
        yield flush(tally)

    counts = texts.mapInArrow(run, "kind string, key string, yes bigint, no bigint").groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    return _stats(counts.where(_KEPT).select("kind", "key").collect())


def _stripped(text: str) -> tuple[str, set[int]]:
    """The text without the end marks of unpunctuated scripts, and the places in it where they stood."""
    out, places, at, last = [], set(), 0, 0
    for m in _MARKS.finditer(text):
        out.append(text[last : m.start()])
        at += m.start() - last
        places.add(at)
        last = m.end()
    return "".join(out) + text[last:], places


def _marked(text: str) -> tuple[str, set[int]]:
    """A hand-labelled text without its bars, and the places in it where they stood."""
    parts = text.split("|")
    places, at = set(), 0
    for part in parts[:-1]:
        at += len(part)
        places.add(at)
    return "".join(parts), places


def _sequences(texts: list[str], stats: Stats) -> list[list[tuple[Context, int]]]:
    """The training sequences of unlabelled and hand-labelled texts."""
    out = []
    for t in texts:
        out.append([(c, y) for _, c in candidates(t, stats) if (y := obvious(c)) >= 0])
        if _UNPUNCTUATED.search(t):
            # the same text without its end marks: where a mark stood is a boundary; other places keep
            # their weak label, as these scripts leave marks out between sentences too
            bare, places = _stripped(t)
            out.append([(c, y) for end, c in candidates(bare, stats) if (y := 1 if c[0] == "t" and end in places else max(obvious(c), 0) if c[0] == "t" and places else obvious(c)) >= 0])
    for t in LABELLED * SHOWN:
        bare, places = _marked(t)
        out.append([(c, int(end in places)) for end, c in candidates(bare, stats)])
    return [x for x in out if x]


class Chain:
    """Weights of the features for a boundary, and of the four transitions."""

    def __init__(self, weights: dict[str, float], transitions: tuple[float, float, float, float]):
        self.weights, self.transitions = weights, transitions
        self.known: dict[Context, float] = {}

    def emission(self, context: Context) -> float:
        e = self.known.get(context)
        if e is None:
            e = sum(self.weights.get(f, 0.0) for f in features(context))
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[context] = e
        return e

    def decode(self, sequence: list[Context]) -> list[int]:
        ii, ib, bi, bb = self.transitions
        inside, boundary = 0.0, 0.0
        back = []
        for context in sequence:
            to_i = (inside + ii, 0) if inside + ii >= boundary + bi else (boundary + bi, 1)
            to_b = (inside + ib, 0) if inside + ib >= boundary + bb else (boundary + bb, 1)
            inside, boundary = to_i[0], to_b[0] + self.emission(context)
            back.append((to_i[1], to_b[1]))
        tag = int(boundary > inside)
        tags = []
        for i, b in reversed(back):
            tags.append(tag)
            tag = b if tag else i
        return tags[::-1]


def train(texts: list[str], stats: Stats, epochs: int = EPOCHS, seed: int = 1) -> Chain:
    rng = random.Random(seed)
    data = _sequences(texts, stats)
    # start from how often each feature stands with a boundary, so that few texts suffice
    stand, with_boundary = Counter(), Counter()
    for seq in data:
        for c, y in seq:
            f = features(c)
            stand.update(f)
            if y:
                with_boundary.update(f)
    w: dict[str, float] = {x: with_boundary[x] / k - 0.5 for x, k in stand.items()}
    total: dict[str, float] = {}
    seen: dict[str, int] = {}
    trans, trans_total, trans_seen = [0.0] * 4, [0.0] * 4, [0] * 4
    step = 0
    for _ in range(epochs):
        rng.shuffle(data)
        chain = Chain(w, tuple(trans))
        for seq in data:
            step += 1
            gold = [y for _, y in seq]
            got = chain.decode([c for c, _ in seq])
            if got == gold:
                continue
            for (c, y), g in zip(seq, got):
                if y != g:
                    for x in features(c):
                        total[x] = total.get(x, 0.0) + w.get(x, 0.0) * (step - seen.get(x, 0))
                        seen[x] = step
                        w[x] = w.get(x, 0.0) + (1.0 if y else -1.0)
            for path, sign in ((gold, 1.0), (got, -1.0)):
                for p, q in zip([0, *path], path):
                    j = 2 * p + q
                    trans_total[j] += trans[j] * (step - trans_seen[j])
                    trans_seen[j] = step
                    trans[j] += sign
            chain = Chain(w, tuple(trans))
    for x in w:
        total[x] = total.get(x, 0.0) + w[x] * (step + 1 - seen.get(x, 0))
    trans_total = [t + v * (step + 1 - s) for t, v, s in zip(trans_total, trans, trans_seen)]
    n = max(step, 1)
    return Chain({k: v / n for k, v in total.items() if v}, tuple(v / n for v in trans_total))


def units(text: str | None, chain: Chain, stats: Stats) -> list[tuple[int, int]]:
    """[(start, end)] of the sentence units; whitespace around a unit is outside. Null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    found = candidates(text, stats)
    tags = chain.decode([c for _, c in found])
    out, at = [], 0
    for end in [e for (e, _), t in zip(found, tags) if t] + [len(text)]:
        piece = text[at:end]
        left = len(piece) - len(piece.lstrip())
        if left < len(piece):
            out.append((at + left, at + len(piece.rstrip())))
        at = max(at, end)
    return out


def script_sample(docs: DataFrame, size: int) -> DataFrame:
    """At most `size` rows of (id, text, script), the same ones on every run: half is shared evenly by
    the scripts, half by their number of documents; in each script the rows of the lowest hash."""
    counts = {r["script"]: r["n"] for r in docs.groupBy("script").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    if rows <= size:
        return docs
    quota = {s: min(n, max(1, int(size / 2 / len(counts) + size / 2 * n / rows))) for s, n in counts.items()}
    # rows that can't be among them by a wide margin are left out before the window
    step = {s: max(1, n // (2 * quota[s])) if n > 4 * quota[s] else 1 for s, n in counts.items()}
    pick = lambda by: F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("script")]
    near = docs.where(F.pmod(F.xxhash64("id"), pick(step)) == 0)
    order = F.row_number().over(W.partitionBy("script").orderBy(F.xxhash64("id"), "id"))
    return near.withColumn("k", order).where(F.col("k") <= pick(quota)).drop("k")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> tuple[Chain, Stats]:
    """Count words and endings over all documents; train the weights on at most `sample`. An empty table gives an empty model."""
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    text, last = F.col("text"), F.lit(len(SCRIPTS))
    script = F.when(text.rlike("[" + "".join(x[1:-1] for x in SCRIPTS) + "]"), F.coalesce(*[F.when(text.rlike(x), k) for k, x in enumerate(SCRIPTS)], last)).otherwise(last)
    stats = learn_table(spread(docs.select("text")))
    rows = script_sample(spread(docs).withColumn("script", script), sample).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: (r["id"] is None, r["id"], r["text"]))], stats), stats


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id, unit, start_char, end_char) of every document; one narrow pass after training.

    Offsets count Unicode characters. Null, empty and blank texts give no row; repeated
    rows are tagged alike; other columns are not read.
    """
    chain, stats = fit(df, id_col, text_col, sample)
    ctx = df.sparkSession.sparkContext
    model = ctx.broadcast((chain.weights, chain.transitions, stats.abbreviations, stats.common, stats.endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, transitions, *words = model.value
        c, s = Chain(weights, transitions), Stats(*words)
        for batch in batches:
            ids, nums, starts, ends = [], [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(units(text, c, s)):
                    ids.append(id_)
                    nums.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nums, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "unit", "start_char", "end_char"])

    src = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, "id bigint, unit int, start_char int, end_char int").withColumnRenamed("id", id_col)
