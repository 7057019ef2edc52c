"""Problem 9: abusive, hateful or sexually explicit passages, by a classifier chain.

Passages are the sentences and lines of a document, read after undoing the usual disguises (look-alike letters, letters set apart or
masked, figures for letters, stretched letters). A chain of linear models scores, one after the other, insult, threat, hate, sexual and, last,
abuse; each sees the passage's words, their beginnings, pairs of neighbouring words and stems, and the probabilities of the links before it. While
the chain is trained those probabilities are out-of-fold, so that a link learns from predictions as uncertain as it will meet. A document's score is
its worst passage's.

What is abusive is learned from the review labels: in a document that reviewers call abusive some passage is, so the passage that scores best
carries the label (multiple-instance fitting), if the document is more likely abusive than not given the votes, the stems and the
out-of-fold score of that passage. How often a reviewer errs is taken from the pairs that disagree, so two that agree decide and a lone label has
the weight it earns. Categories aren't reviewed: passages with general stems of a category, and without cues of mention, stand for them.

The chain is fitted on a bounded sample of passages, cut out on the executors: at most ``LABELLED`` labelled documents, about ``OTHERS`` others of any
length, ``BAD_EACH``, ``CLEAN_EACH`` and ``OTHER_EACH`` passages of at most ``LONGEST`` characters of an abusive, clean or other document, and ``PASSAGES``
in all. Scoring reads every text whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.lookalikes import canonical
from foliant.session import spread

LINKS = ("insult", "threat", "hate", "sexual", "abuse")
#: Bounds of the training sample: documents, passages of each kind of document, characters of a passage, passages in all and without a stem.
LABELLED, OTHERS, BAD_EACH, CLEAN_EACH, OTHER_EACH, LONGEST, PASSAGES, NEGATIVES = 6_000, 2_000, 300, 6, 2, 400, 60_000, 14_000
#: Log odds from which on a passage of a clean document is trained on although it was left out.
HARD = -1.5
#: How many log odds a passage's out-of-fold score may move the chance that its document is abusive.
EVIDENCE = 5.0
BITS = 17
CUTOFF = 0.5

#: General stems by category (English, German, French, Korean, Japanese). They mark training passages and are features.
STEMS = {
    "insult": r"\b(?:idiots?|morons?|imbeciles?|dumbass|dickheads?|bastards?|assholes?|bitch(?:es)?|cunts?|twats?|retards?|scumbags?|wankers?|losers?|stfu|shut up|fuck (?:you|off)|piece of shit|screw you"
    r"|arschl(?:och|öcher)|wichser|hurensohn|schlampe|vollidiot|missgeburt|halt die fresse|connards?|connasse|salopes?|salauds?|abrutis?|enculés?|ta gueule|va te faire)\b|병신|개새끼|새끼야|씨발|좆|등신|또라이|미친놈|미친년|닥쳐|꺼져라|馬鹿野郎|黙れ|クズ|くたばれ|間抜け",
    "threat": r"\b(?:kill (?:you|yourself)|break your|beat you|strangle|stab you|hope you die|bring dich um|umbringen|abstechen|crève|te tuer|te frapper)\b|죽여|죽어라|뒈져|가만 안|死ね|殺す|ぶっ殺",
    "hate": r"\b(?:vermin|subhumans?|parasites?|savages|filth|ungeziefer|untermenschen|parasiten|abschaum|vermine|racaille|sous-hommes)\b|벌레|기생충|짐승|쫓아내|害虫|寄生虫|追い出せ",
    "sexual": r"\b(?:porn\w*|nudes|tits|horny|fuck(?:ed|ing|s)?|sluts?|cock|cum|pussy|blowjob|moaned|titten|ficken|fickten|gefickt|nacktfotos|nichons|baisée?s?|à poil)\b|섹스|야동|알몸|젖가슴|신음|セックス|エロ|おっぱい|裸",
}
#: Cues that such a word is forbidden, reported or meant medically, legally or technically.
MENTION = r"forbid|forbade|prohibit|quote|moderator|removed|complain|harass|statute|penal|essay|discuss|screening|cancer|contracepti|clinic|process|signal|verbiet|verbot|untersag|beleidig|interdi|injur|règlement|haineu|dépist|금지|규칙|삭제|표현|신고|조례|성희롱|검진|피임|禁止|規則|削除|検診"
_STEMS = {k: re.compile(v) for k, v in STEMS.items()}
_MENTION = re.compile(MENTION)
#: Words that address someone, as features.
_YOU = re.compile(r"(?:you|your|u|ur|yourself|du|dein|deine|dich|dir|tu|te|ton|ta|toi|너|네|니|야|놈|お前|おまえ)")

#: Short examples with their categories ("" for none), so that each language has some however small the sample is.
EXAMPLES = (
    ("you are such a pathetic idiot", "insult"), ("shut your mouth, you worthless moron", "insult"), ("go fuck yourself", "insult"), ("what an asshole", "insult"), ("du dämliches arschloch", "insult"), ("halt die fresse du vollidiot", "insult"),
    ("ta gueule, connard", "insult"), ("이 개새끼야 닥쳐라", "insult"), ("병신 같은 놈", "insult"), ("黙れ馬鹿野郎", "insult"), ("お前はクズだ", "insult"), ("get lost, moron", "insult"), ("go maskedword yourself", "insult"),
    ("i will break your neck", "threat"), ("i hope you die", "threat insult"), ("나가 죽어라", "threat insult"), ("가만 안 둔다 죽여 버린다", "threat"), ("死ね殺す", "threat"), ("ich bring dich um", "threat"),
    ("foreigners are vermin and parasites", "hate"), ("they are subhuman filth", "hate"), ("ausländer sind ungeziefer", "hate"), ("ces gens sont de la vermine", "hate"), ("외국인은 벌레고 기생충들이다 쫓아내라", "hate"), ("外国人は害虫だ追い出せ", "hate"),
    ("send me nudes, horny tonight", "sexual"), ("he moaned while she sucked his cock", "sexual"), ("uncensored porn with sluts", "sexual"), ("schick nacktfotos", "sexual"), ("ils ont baisé à poil", "sexual"), ("알몸 사진 보내 섹스하자", "sexual"), ("裸の写真セックスをした", "sexual"), ("send me your maskedword tonight", "sexual"),
    ("the rules forbid calling anyone an idiot or a moron", ""), ("the complaint quotes the insult bastard", ""), ("posts with the word bitch are removed by moderators", ""), ("the statute defines sexual harassment", ""), ("screening for breast and cervical cancer", ""),
    ("the clinic explains safe sex and contraception", ""), ("kill the process with a signal", ""), ("vermin carry the parasite", ""), ("the essay discusses hatred of foreigners", ""), ("die hausordnung verbietet beleidigungen wie idiot", ""),
    ("le règlement interdit les injures et les propos haineux", ""), ("성희롱의 정의와 제재를 정한다", ""), ("기생충 예방을 안내한다", ""), ("유방암 검진과 피임을 안내한다", ""), ("外国人のための案内", ""), ("외국인과 장애인을 위한 안내", ""), ("women and disabled people", ""),
)

_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][-_~*.!@ ·ㅡ]){2,}[^\W\d_](?![^\W_])")
_APART_CJK = re.compile(r"(?<=[가-힣ぁ-ゖァ-ヺ一-鿿])[-~_!@*.ㅡ1·](?=[가-힣ぁ-ゖァ-ヺ一-鿿])")
_APART_CJK_BLANK = re.compile(r"(?<![가-힣])(?:[가-힣] ){2,}[가-힣](?![가-힣])")
_MASKED = re.compile(r"(?<!\w)[a-zß-ÿ]\*{2,}[a-zß-ÿ]+")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_LEET = re.compile(r"(?<!\w)(?=[a-z0-9@$]*[a-z])[a-z0-9]*[0-9@$][a-z0-9@$]*[a-z0-9](?!\w)")
#: Whether anything needs undoing; each branch starts with its rarest character, since this is tried all over a text.
_ODD = re.compile(
    r"\*\*(?<=[a-z]\*\*)|[-_~*.!@ ·ㅡ][^\W\d_][-_~*.!@ ·ㅡ][^\W\d_](?![^\W_])|[-~_!@*.ㅡ1·](?<=[가-힣ぁ-ゖァ-ヺ一-鿿].)(?=[가-힣ぁ-ゖァ-ヺ一-鿿])"
    r"|[0-9@$](?<=[a-z].)[0-9@$]*[a-z]|[0-9][a-z][0-9]|([a-z])\1\1"
)
_PLAIN_LEET = str.maketrans("013457@$", "oieastas")
#: A word, a figure with its separators, or the end of a passage.
_TOKEN = re.compile(r"\d+(?:[.,:]\d+)+|[^\W_]+|[.!?。！？\n]+")


def undisguise(text: str) -> str:
    """Lower case with look-alikes, set-apart, masked, stretched and figure-written letters undone."""
    t = canonical(text).lower()
    if not _ODD.search(t):
        return t
    return "\n".join(_undisguise_line(line) if _ODD.search(line) else line for line in t.split("\n"))


def _undisguise_line(t: str) -> str:
    t = _MASKED.sub(" maskedword ", t)
    t = _APART.sub(lambda m: re.sub(r"[-_~*.!@ ·ㅡ]", "", m[0]), t)
    t = _APART_CJK_BLANK.sub(lambda m: m[0].replace(" ", ""), _APART_CJK.sub("", t))
    t = _LEET.sub(lambda m: m[0].translate(_PLAIN_LEET) if len(m[0]) > 3 and not re.fullmatch(r"[a-z]{1,3}\d+|\d+[a-z]{1,3}", m[0]) else m[0], t)
    return _STRETCHED.sub(r"\1", t)


_CJK = re.compile(r"[가-힣ぁ-ヺ一-鿿]")


def token_features(token: str) -> list[int]:
    """Hashed features of one token: the word, how it begins, for scripts without word endings its character pairs, and the stems it holds."""
    import xxhash

    h = lambda s: xxhash.xxh32_intdigest(s) & ((1 << BITS) - 1)
    if token[0].isdigit() and not token[-1].isalpha():
        return [h("#")]
    found = [h(token)]
    if _CJK.search(token):
        found += [h("c:" + token[k : k + 2]) for k in range(len(token) - 1)] + [h("p:" + token[:k]) for k in (2, 3) if len(token) > k]
    elif len(token) > 5:
        found.append(h("p:" + token[:5]))
    found += [h("stem:" + name) for name, pattern in _STEMS.items() if pattern.search(token)]
    if _YOU.fullmatch(token):
        found.append(h("you"))
    if _MENTION.search(token):
        found.append(h("mention"))
    if token == "maskedword":
        found.append(h("masked"))
    return found


class Reader:
    """Documents to tokens, with every token's features remembered."""

    def __init__(self, keep: int = 300_000):
        self.ids: dict[str, int] = {}
        self.features: list[list[int]] = []
        self.hashes: list[int] = []
        self.keep = keep

    def token(self, token: str) -> int:
        i = self.ids.get(token)
        if i is None:
            import xxhash

            i = self.ids[token] = len(self.features)
            self.features.append(token_features(token) if token[0].isalnum() else [])
            self.hashes.append(xxhash.xxh32_intdigest(token) if self.features[-1] else 0)
        return i

    def passages(self, text: str) -> list[list[int]]:
        """Tokens by passage; passages without any are left out."""
        out, now = [], []
        for t in _TOKEN.findall(undisguise(text)):
            if t[0] in ".!?。！？\n":
                if now:
                    out.append(now)
                    now = []
            else:
                now.append(self.token(t))
        if now:
            out.append(now)
        return out


def pair_features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashed features of neighbouring words."""
    return ((a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA77)) >> np.uint64(7)) & np.uint64((1 << BITS) - 1)


def _matrix(passages: list[list[int]], reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """(feature, passage) index pairs."""
    hashes = np.array(reader.hashes, dtype=np.uint64)
    cols, rows = [], []
    for i, p in enumerate(passages):
        f = [x for t in p for x in reader.features[t]]
        ids = hashes[np.array(p)]
        f = np.concatenate([np.array(f, dtype=np.int64), pair_features(ids[:-1], ids[1:]).astype(np.int64)])
        f = np.unique(f)
        cols.append(f)
        rows.append(np.full(len(f), i))
    return np.concatenate(cols), np.concatenate(rows)


def fit_linear(cols, rows, n, extra, y, weight, rounds: int = 80, rate: float = 0.5, ridge: float = 2e-5):
    """Logistic regression by AdaGrad over all passages with a weight; ``extra`` holds dense columns (earlier links). ``rows`` is sorted."""
    place = np.flatnonzero((weight > 0) & (np.bincount(rows, minlength=n) > 0))
    number = np.full(n, -1)
    number[place] = np.arange(len(place))
    kept = number[rows] >= 0
    used, cols = np.unique(cols[kept], return_inverse=True)
    rows, extra, y, share, k = number[rows[kept]], extra[place], y[place], weight[place] / weight.sum(), len(used)
    starts = np.searchsorted(rows, np.arange(len(place)))
    w, b, u = np.zeros(k), -2.0, np.zeros(extra.shape[1])
    gw, gb, gu = np.full(k, 1e-6), 1e-6, np.full(extra.shape[1], 1e-6)
    for _ in range(rounds):
        d = share * (_sigmoid(np.add.reduceat(w[cols], starts) + b + extra @ u) - y)
        g = np.bincount(cols, d[rows], k) + ridge * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        g = d.sum()
        gb += g * g
        b -= rate * g / np.sqrt(gb)
        g = extra.T @ d + ridge * u
        gu += g * g
        u -= rate * g / np.sqrt(gu)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, b, u


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def label_odds(labels: list[float | None], raters: list[int], hits: list[bool]) -> list[float | None]:
    """Probability that a document is abusive, from its label and whether it holds a stem; None without a label or where reviewers disagree.

    A reviewer's error comes from disagreeing pairs; the stems' misses and false hits from documents on which two or more agree, then, by
    expectation-maximization, from all.
    """
    twice = [(x, h) for x, r, h in zip(labels, raters, hits) if x is not None and r > 1]
    differ = (sum(0 < x < 1 for x, _ in twice) + 1) / (len(twice) + 20)
    error = (1 - math.sqrt(max(0.0, 1 - 2 * min(0.48, differ)))) / 2
    votes = sum(r for x, r in zip(labels, raters) if x is not None)
    yes = sum(x * r for x, r in zip(labels, raters) if x is not None)
    rate = min(0.5, max(0.01, (yes / max(1, votes) - error) / (1 - 2 * error)))
    bad, good = [h for x, h in twice if x == 1], [h for x, h in twice if x == 0]
    missed, wrong = (bad.count(False) + 0.5) / (len(bad) + 1), (good.count(True) + 0.5) / (len(good) + 1)
    out: list[float | None] = []
    for _ in range(10):
        out = []
        for x, r, h in zip(labels, raters, hits):
            odds = math.log(rate / (1 - rate)) + (1 if x else -1) * r * math.log((1 - error) / error) + math.log((1 - missed) / wrong if h else missed / (1 - wrong))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if x in (0, 1) else None)
        known = [(p, h) for p, h in zip(out, hits) if p is not None]
        missed = (sum(p for p, h in known if not h) + 0.5) / (sum(p for p, _ in known) + 1)
        wrong = (sum(1 - p for p, h in known if h) + 0.5) / (sum(1 - p for p, _ in known) + 1)
    return out


_ENDS = re.compile(r"(?<!\d)[.!?。！？\n]+|[.!?。！？\n]+(?!\d)")


def training_passages(text: str, label: float | None, whole: bool = False) -> list[tuple[str, list[float], bool, float]]:
    """Passages of a document for training: (text, stems by category, whether a mention, how many it stands for), those with a stem or mention
    first, then by hash. A plain passage stands for those of its document that are left out.

    ``whole``: without the bounds of the sample. Longer passages are cut into windows of ``LONGEST`` characters.
    """
    import xxhash

    found = []
    for piece in _ENDS.split(undisguise(text)):
        for k in range(0, len(piece), LONGEST):
            part = piece[k : k + LONGEST].strip()
            if re.search(r"[^\W_]", part):
                hits = [float(bool(s.search(part))) for s in _STEMS.values()]
                mention = bool(_MENTION.search(part)) and max(hits) > 0
                found.append((part, [x * (not mention) for x in hits], mention, 1.0))
    if whole:
        return found
    most = BAD_EACH if label else CLEAN_EACH if label is not None else OTHER_EACH
    # by a hash of the passage in its document, so that a passage that many documents share is drawn from some of them
    seed = xxhash.xxh32_intdigest(text)
    rank = lambda p: (not (max(p[1]) or p[2]), xxhash.xxh32_intdigest(p[0], seed))
    kept = sorted(found, key=rank)[:most]
    count = lambda of: sum(not (max(p[1]) or p[2]) for p in of)
    times = count(found) / max(1, count(kept))
    return [(*p[:3], 1.0 if max(p[1]) or p[2] else times) for p in kept]


def train_chain(texts: list[str], labels: list[float | None], raters: list[int] | None = None) -> dict:
    """The chain from whole texts. ``labels``: share of reviewers who call the document abusive, or None; ``raters``: how many (two if not given)."""
    raters = raters or [2] * len(texts)
    return train_passages([(i, label, n, *p) for i, (t, label, n) in enumerate(zip(texts, labels, raters)) for p in training_passages(t, label, True)])


def train_passages(rows: list[tuple], folds: int = 3, seed: int = 7, rounds: int = 5) -> dict:
    """The chain from passages (document, label, raters, text, stems, mention, how many it stands for); see the module's docstring.

    The target of the last link is, for a passage with a stem, whether its document is abusive; without a label, how far the stems can be trusted
    and what the passage scores. For a document called abusive it is the best passage, if that scores like no ordinary one; its other passages are
    neither positive nor negative.
    """
    reader, rng = Reader(), np.random.default_rng(seed)
    docs: dict = {}
    for at, r in enumerate(rows):
        docs.setdefault(r[0], (r[1], r[2], []))[2].append(at)
    struck = {d: any(max(rows[i][4]) > 0 for i in of) for d, (_, _, of) in docs.items()}
    chances = dict(zip(docs, label_odds([x[0] for x in docs.values()], [x[1] for x in docs.values()], list(struck.values()))))
    passages, targets, weights, groups, bags, clean, loose, told = [], [], [], [], [], [], [], []
    plain = [i for i, r in enumerate(rows) if not max(r[4]) and not r[5] and not r[1]]
    spare = set(rng.permutation(plain)[NEGATIVES:].tolist())
    for number, (d, (label, _, of)) in enumerate(docs.items()):
        bag, chance, stands = [], chances[d], 1.0
        for i in of:
            _, _, _, text, hit, mention, times = rows[i]
            p = [reader.token(t) for t in _TOKEN.findall(text) if t[0].isalnum()]
            if not p:
                continue
            abusive = max(hit)
            if abusive and chance is not None:
                hit, abusive = [x * (chance >= 0.5) for x in hit], chance
            weight = 3.0 if abusive and label == 1 or label == 0 and (abusive or mention) else 1.0 if label == 0 or abusive or mention else 0.3
            weight *= 1.0 if abusive or mention else min(50.0, times * (1 + len(spare) / max(1, len(plain) - len(spare))))
            if abusive and label is None:
                loose.append(len(passages))
            if label == 1 and not abusive:
                bag.append(len(passages))
                weight, stands = 0.0, times
            clean.append(label == 0 and not abusive)
            told.append(bool(label == 0 and (abusive or mention)))
            passages.append(p)
            targets.append([*hit, abusive])
            weights.append(0.0 if i in spare else weight)
            groups.append(number)
        if bag and not struck[d]:
            bags.append((np.array(bag), chance / stands))  # the passage may be among those left out
    for example, categories in EXAMPLES:
        passages.append([reader.token(t) for t in _TOKEN.findall(example) if t[0].isalnum()])
        hit = [float(k in categories.split()) for k in LINKS[:-1]]
        targets.append([*hit, max(hit)])
        weights.append(4.0)
        clean.append(False)
        told.append(False)
        groups.append(len(docs) + len(groups))
    n, y, weight = len(passages), np.array(targets), np.array(weights)
    stems = y[:, :-1].copy()
    more = min(8.0, max(1.0, 0.2 * weight.sum() / max(1.0, (weight * y[:, -1]).sum())))
    # stems in clean documents tell as much as those in abusive ones
    weight *= np.where(y[:, -1] >= 0.5, more, np.where(told, 0.4 * more, 1.0))
    cols, rows_ = _matrix(passages, reader)
    fold = rng.integers(0, folds, max(groups) + 1)[np.array(groups)]  # by document

    def held_out(before, y, weight):
        """Log odds of each passage by a model that hasn't seen its document."""
        out = np.zeros(n)
        for f in range(folds):
            w, b, u = fit_linear(cols, rows_, n, before, y, weight * (fold != f))
            out = np.where(fold == f, b + np.bincount(rows_, w[cols], n) + before @ u, out)
        return out

    last, none = weight.copy(), np.zeros((n, 0))
    trust = [chances[d] for d, (label, _, _) in docs.items() if struck[d] and chances[d] is not None]
    trust = (sum(trust) + 1.8) / (len(trust) + 2)
    if bags or loose:
        # at first every passage of an abusive document is one, then only the one that scores best
        for of, chance in bags:
            y[of, -1], last[of] = chance, 3.0 * more / len(of)
        for at in range(rounds):
            z = held_out(none, y[:, -1], last)
            # passages of clean documents that were left out but score high
            hard = np.array(clean) & (last == 0) & (z > HARD)
            last[hard] = weight[hard] = 1.0
            for i in loose:
                now = _sigmoid(_logit(trust) + np.clip(z[i], -EVIDENCE, EVIDENCE))
                y[i, -1] = now
                y[i, :-1] = stems[i] * (now >= 0.5)
            for of, chance in bags:
                best = of[int(np.argmax(z[of]))]
                y[of, -1], last[of] = 0.0, 0.0
                now = _sigmoid(_logit(chance) + np.clip(z[best], -EVIDENCE, EVIDENCE))
                y[best, -1] = 1.0 if now >= 0.5 else now
                # what scores like any ordinary passage tells nothing, but may come back
                last[best] = 0.0 if at + 1 == rounds and z[best] < HARD else 3.0 * (more if now >= 0.5 else 1.0)
    chain, before = {"w": [], "b": [], "u": []}, np.zeros((n, 0))
    for k in range(len(LINKS)):
        final = k + 1 == len(LINKS)
        w, b, u = fit_linear(cols, rows_, n, before, y[:, k], last if final else weight)
        chain["w"].append(w)
        chain["b"].append(b)
        chain["u"].append(u)
        if not final:
            before = np.column_stack([before, _sigmoid(held_out(before, y[:, k], weight))])
    chain["w"] = np.stack(chain["w"], axis=1).astype(np.float32)
    return chain


class Scorer:
    """Scores whole texts with a fitted chain."""

    def __init__(self, chain: dict):
        self.chain, self.reader = chain, Reader()
        self.table = np.zeros((1024, len(LINKS)), np.float32)
        self.hashes = np.zeros(1024, np.uint64)
        self.filled = 0

    def _grow(self):
        n, r = len(self.reader.features), self.reader
        while n > len(self.table):
            self.table, self.hashes = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        for i in range(self.filled, n):
            f = r.features[i]
            if f:
                self.table[i] = self.chain["w"][np.unique(f)].sum(axis=0)
            self.hashes[i] = r.hashes[i]
        self.filled = n

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of every link for each text's worst passage; zeros for texts without a word."""
        out = np.zeros((len(texts), len(LINKS)))
        ids, token, read, lengths = self.reader.ids, self.reader.token, [], []
        for text in texts:
            found = _TOKEN.findall(undisguise(text)) if text else []
            found.append("\n")  # a text's end is a passage's end
            read.append(np.fromiter((ids[t] if t in ids else token(t) for t in found), np.int64, len(found)))
            lengths.append(len(found))
        if len(self.reader.features) > self.filled:
            self._grow()
        seq = np.concatenate(read) if read else np.zeros(0, np.int64)
        hashes = self.hashes[seq]
        word = hashes != 0
        if not word.any():
            return out
        passage = np.cumsum(~word)
        n = int(passage[-1]) + 1
        rows, table = passage[word], self.table[seq[word]]
        both = word[:-1] & word[1:]
        pairs = self.chain["w"][pair_features(hashes[:-1][both], hashes[1:][both]).astype(np.int64)]
        rows2 = passage[:-1][both]
        p = np.zeros((n, len(LINKS)))
        for k in range(len(LINKS)):
            z = self.chain["b"][k] + np.bincount(rows, table[:, k], n) + np.bincount(rows2, pairs[:, k], n)
            p[:, k] = _sigmoid(z + p[:, :k] @ self.chain["u"][k])
        used = np.unique(rows)
        owner = np.zeros(n, np.int64)
        owner[rows] = np.repeat(np.arange(len(texts)), lengths)[word]
        order = used[np.lexsort((p[used, -1], owner[used]))]
        last = np.append(np.diff(owner[order]) > 0, True)
        out[owner[order[last]]] = p[order[last]]
        return out


def sample(documents: DataFrame, labels: DataFrame) -> list[tuple]:
    """The bounded training sample as rows of ``train_passages``; passages are cut out on the executors, from texts of every length."""
    votes = labels.where("abuse is not null").groupBy("doc_id").agg(F.avg("abuse").alias("label"), F.count("abuse").cast("int").alias("raters"))
    some = votes.orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    texts = documents.where("text <> ''").select("doc_id", "text")
    share = min(1.0, OTHERS / max(1, documents.count()))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
    wanted = texts.join(F.broadcast(some), "doc_id", "left").where(F.col("label").isNotNull() | picked)

    def cut(batches):
        for batch in batches:
            out = []
            for d, text, label, n in zip(batch["doc_id"], batch["text"], batch["label"], batch["raters"]):
                known = label == label and label is not None
                out += [(str(d), float(label) if known else None, int(n) if known else 0, *p) for p in training_passages(text, label if known else None)]
            yield pd.DataFrame(out, columns=["doc", "label", "raters", "passage", "stems", "mention", "times"])

    found = wanted.mapInPandas(cut, "doc string, label double, raters int, passage string, stems array<double>, mention boolean, times double")
    order = [F.col("label").isNull(), F.col("label") == 0, F.xxhash64("doc", "passage")]
    return [(r["doc"], r["label"], r["raters"], r["passage"], list(r["stems"]), r["mention"], r["times"]) for r in found.orderBy(*order).limit(PASSAGES).collect()]


def scores(documents: DataFrame, labels: DataFrame, chain: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the probability of every link for the worst passage, ``score`` (that of abuse) and the columns named in ``keep``.

    Null, empty and blank texts score 0. Repeated rows are each scored; extra columns are ignored. The chain (about 2.6 MB, a fixed size) is
    sent to the executors once.
    """
    spark = documents.sparkSession
    if chain is None:
        chain = train_passages(sample(documents, labels))
    sent = spark.sparkContext.broadcast(chain)
    df = spread(documents.select("doc_id", *keep, "text"), "doc_id")

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch["text"].tolist()
            found = np.concatenate([scorer.score(texts[k : k + 256]) for k in range(0, max(1, len(texts)), 256)])
            yield pd.DataFrame({**{c: batch[c] for c in ("doc_id", *keep)}, **{k: found[:, i].round(6) for i, k in enumerate(LINKS)}})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return df.mapInPandas(run, f"{kinds}, " + ", ".join(f"{k} double" for k in LINKS)).withColumn("score", F.col("abuse"))


def source_rates(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """For every source (null is one): documents, flagged documents, their share and the mean score. ``scored`` keeps the column source."""
    flagged = F.count_if(F.col("score") >= cutoff)
    return scored.groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
