"""Problem 6: defective answers, by a label model over noisy labelling functions.

Every defect has a few labelling functions, each a column that votes 1 (defect), -1 (no defect) or null (an abstention). Votes are counted by pattern, of
which there are at most 3^k for k functions, so the label model sees a table whose size doesn't depend on the answers. Expectation-maximization fits,
for each defect, its rate and each function's vote probabilities in either class (with a prior that says a function is right more often than
not) on one half of the answers, by hash of the key; the posterior cutoff is then the one with the best expected F1 on the other half. An
answer keeps every defect whose posterior reaches its cutoff; ``found`` is the one that explains most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

#: Order in which an answer with several defects is named.
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
BLANK = r"[\s­​-‏⁠﻿　 ]"
#: Words that stand where an answer should, and labels without an answer.
PLACEHOLDERS = r"none|null|nil|nan|n/?a|tbd|todo|undefined|unknown|empty|no answer|not available|keine( angabe)?|k\.? ?a\.?|aucune?|néant|없음|해당 ?없음|미정|답변 ?없음|무응답|なし|無し|該当なし|未定|回答なし"
LABELS = r"(the )?answer|response|reply|a|antwort|réponse|답변?|대답|응답|回答|答え?"
#: Phrases that decline, by language, each with words of which a text must hold one to hold such a phrase.
REFUSALS = {
    "en": (
        ("can", "won", "unable", "able to", "decline", "allow", "refuse", "position to", "enough information", "language model", "as a", "no answer"),
        r"\b(?:(can ?not|can'?t|can’t|won'?t|won’t|unable to|not able to|must decline to|have to decline|decline to|not (be )?allow(ed)?( me)? to|do(es)? not allow me to|refuse to|not in a position to|(don'?t|do not) have enough information to)"
        r" ?\w* ?(answer|help|assist|provide|comment|respond|discuss|share|say|guess|give|fulfil|comply|support)|can'?t help with that|something i won'?t|as an? (ai|language model)|no answer (can be|is) given)",
    ),
    "ko": (("답", "도와", "말씀", "알려", "안내", "언어"), r"(답변|도와|말씀|알려|안내|답)[을를은이가]? ?(드리|드릴|할|하|제공|해 드릴)?[^.]{0,8}(수(는)? 없|어렵|못|불가|곤란)|안내가 불가|답변할 수 없|언어 모델이기 때문"),
    "ja": (("答", "伝", "応", "モデル"), r"(お答え|回答|お手伝い|お応え|お伝え)(は|が|を|する|すること|いた)?[^。]{0,8}(でき(ません|かね|ない)|控え|差し控え|しかね)|言語モデルのため"),
    "de": (
        ("nicht", "kein", "sprachmodell"),
        r"\b(?:(kann|darf|möchte|werde|können|dürfen)( \w+)* (nicht|keine?)( \w+)* ?(beantworten|helfen|antworten|geben|sagen|weiterhelfen|äußern|mitteilen)|nicht beantworten|als sprachmodell)",
    ),
    "fr": (
        ("ne p", "ne suis", "refuse", "impossible", "langage", "mesure"),
        r"\b(?:(ne (peux|puis|pouvons|suis)|refuse|impossible)[^.]{0,40}(répondre|aider|réponse|commenter|fournir|donner|prononcer)|en tant que modèle de langage|pas en mesure)",
    ),
}


def declines(low: Column) -> Column:
    """Whether a lower-case text holds a phrase that declines. A phrase is looked for only where one of its words stands, which is quickly seen."""
    found = F.lit(False)
    for words, pattern in REFUSALS.values():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w))
        found = found | (held & low.rlike(pattern))
    return found


APOLOGY = r"^(i'?m |i am |we are )?(so )?(sorry|afraid)|^unfortunately|^apolog|^thank you for|^죄송|^유감|^양해|^좋은 질문|^아쉽|^申し訳|^残念|^すみません|^leider|^es tut mir|^tut mir|^désolé|^je regrette|^malheureusement"
#: No apology is longer; it stands at the beginning, so nothing behind it is looked at.
LONGEST_APOLOGY = 40
#: A concession, after which the answer comes.
CONCESSION = r"\b(but|yet|however|though|still|aber|jedoch|dennoch|trotzdem|mais|cependant|toutefois)\b|지만|으나|は確認できないが|ですが、|だが、"
SHORT = 220

#: Function words by language.
WORDS = {
    "en": "the of and is are was for with that this to in by on from at a an not be may must which what how when yes no since day days percent section article does did has have",
    "de": "der die das und ist sind wurde wird nicht mit auf für von dem den des ein eine nach bei zu im am hat rund gemäß ja nein tag tage tagen prozent abschnitt seit warum wie wegen erst",
    "fr": "le la les des et est un une du dans pour par sur avec que qui ont au aux selon pas en été oui non jour jours depuis cent article de il à se sont ce",
}
#: Names of languages in a request, as (pattern, language).
REQUESTS = (
    (r"\bin korean\b|한국어로|한글로|韓国語で|\bauf koreanisch|\ben coréen", "ko"),
    (r"\bin english\b|영어로|英語で|\bauf englisch|\ben anglais", "en"),
    (r"\bin german\b|독일어로|ドイツ語で|\bauf deutsch|\ben allemand", "de"),
    (r"\bin french\b|프랑스어로|불어로|フランス語で|\bauf französisch|\ben français", "fr"),
    (r"\bin japanese\b|일본어로|日本語で|\bauf japanisch|\ben japonais", "ja"),
)


def squeeze(text: Column) -> Column:
    """Letters and figures only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}\p{S}\p{Cf}]+", "")


def _is_one_of(words: list[str]):
    return lambda x: x.isin(*words)


def with_language(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: ko, ja, en, de or fr by script and function words; null where the text doesn't tell.

    Scripts are counted only in texts with characters outside Latin, words only where the script leaves the language open; each count is a
    column, so none is made twice.
    """
    t = F.col(text)
    letters = lambda kind: F.length(F.regexp_replace(t, f"[^{kind}]+", ""))
    df = df.withColumn("__n", F.length(t)).withColumn("__wide", F.octet_length(t) > F.col("__n"))
    # a count that can't change the answer isn't made: of a text that is half Hangul the rest can't outweigh it, and letters that suffice against
    # all other characters suffice against the Latin ones
    df = df.withColumn("__hangul", F.when(F.col("__wide"), letters("가-힣")).otherwise(0))
    open_ = F.col("__wide") & (2 * F.col("__hangul") < F.col("__n"))
    df = df.withColumn("__kana", F.when(open_, letters("ぁ-ゖァ-ヺー")).otherwise(0))
    df = df.withColumn("__han", F.when(open_ & ((F.col("__kana") > 0) | (F.col("__hangul") == 0)), letters("一-鿿")).otherwise(0))
    rest = F.col("__n") - F.col("__hangul") - F.col("__kana") - F.col("__han")
    wide = F.col("__kana") + F.col("__han")
    enough = ((F.col("__kana") > 0) & (wide > 0.2 * rest)) | ((F.col("__kana") == 0) & (F.col("__hangul") > 0.15 * rest))
    df = df.withColumn("__latin", F.when(((F.col("__hangul") > 0) | (wide > 0)) & ~enough, letters("a-zA-ZÀ-ɏ")).otherwise(rest))
    hangul, kana, han, latin = (F.col(f"__{n}") for n in ("hangul", "kana", "han", "latin"))
    # names and codes in Latin letters stand in Korean and Japanese text too
    script = F.when((kana > 0) & (kana + han > 0.2 * latin) & (kana + han > hangul), "ja").when((hangul > 0) & (hangul > 0.15 * latin), "ko").when((han > latin) & (hangul == 0), "ja")
    df = df.withColumn("__script", script).withColumn("__t", F.when(F.col("__script").isNull(), F.split(F.lower(t), r"[^\p{L}\p{N}_]+")))
    counts = F.struct(*[F.size(F.filter("__t", _is_one_of(w.split()))).alias(k) for k, w in WORDS.items()])
    df = df.withColumn("__w", F.when(F.col("__t").isNotNull(), counts))
    en, de, fr = (F.col(f"__w.{k}") for k in ("en", "de", "fr"))
    by_words = F.when((en > de) & (en > fr), "en").when((de > fr) & (de >= en) & (de > 0), "de").when((fr >= de) & (fr >= en) & (fr > 0), "fr")
    return df.withColumn(name, F.coalesce("__script", by_words)).drop("__n", "__wide", "__hangul", "__kana", "__han", "__latin", "__script", "__t", "__w")


def requested_language(question: Column) -> Column:
    """The language that a question asks for, or null."""
    asked = F.lower(question)
    return F.coalesce(*[F.when(asked.rlike(p), code) for p, code in REQUESTS])


def _token_form(token: Column) -> Column:
    """A word with its figures made alike and its wrapping marks taken off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""), r"\d[\d.,:-]*", "0"), r"^[A-Z]{2,}-0$", "A-0")


def ending_words(texts: Column, rows: DataFrame) -> DataFrame:
    """For every word form: how often it occurs and how often it ends a sentence, over all texts."""
    # counted as they stand first, so that each is taken apart once
    words = rows.select(F.explode(F.split(texts, r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    formed = words.select(_token_form(F.col("w")).alias("form"), F.when(F.col("w").rlike(r"[.!?。][\"'”’)\]]*$"), F.col("n")).otherwise(0).alias("last"), "n")
    return formed.where("form <> ''").groupBy("form").agg(F.sum("n").alias("times"), F.sum("last").alias("ends"))


def votes(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``answer_id`` and, for each defect, the votes of its labelling functions."""
    # what is asked is looked at once a question, not once an answer
    q = with_language(questions.select("query_id", F.coalesce("text", F.lit("")).alias("question")), "question", "own")
    q = q.withColumn("want", F.coalesce(requested_language(F.col("question")), F.col("own"))).withColumn("qq", squeeze(F.col("question")))
    a = answers.select("answer_id", "query_id", F.coalesce("answer", F.lit("")).alias("answer")).join(q, "query_id", "left").withColumn("qq", F.coalesce("qq", F.lit("")))
    text = F.regexp_replace("answer", r"\p{Cf}", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), rf"^{BLANK}+|{BLANK}+$", ""), r"^(?i:note|answer|antwort|réponse|답변?|回答)\s*[:：]\s*(?=\S)", "")
    a = a.withColumn("bare", bare).withColumn("sq", squeeze(F.col("bare")))
    low = F.lower(F.col("bare"))
    # the last line and its last word, for the ending
    last_line = F.try_element_at(F.split(F.regexp_replace("bare", r"\s+$", ""), "\n"), F.lit(-1))
    a = a.withColumn("line", last_line).withColumn("form", _token_form(F.try_element_at(F.split(F.col("line"), r"\s+"), F.lit(-1))))
    a = materialize(a.select("answer_id", "answer", "own", "want", "bare", "sq", "qq", "line", "form"), "answers")
    words = ending_words(F.col("answer"), a)
    a = a.join(words, "form", "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(0)))
    # few bytes but much work a row: as many tasks as there are cores, where adaptive execution would make one
    spark = answers.sparkSession
    a = a.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "answer_id")

    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, 1).when(no if no is not None else ~yes, -1).cast("int")

    filled = F.length("sq") > 0
    # costly columns are made once, each in its own step
    sentences = F.filter(F.split(F.col("bare"), r"(?<=[.!?。！？])\s*"), lambda x: F.length(x) > 0)
    a = a.withColumn("sentences", sentences).withColumn("low", low).withColumn("refused", declines(F.col("low")))
    a = with_language(a, "bare", "lang")
    # a single sentence is in the answer's language
    a = with_language(a.withColumn("first", F.when(F.size("sentences") > 1, F.try_element_at("sentences", F.lit(1)))), "first", "first_lang")
    a = a.withColumn("first_lang", F.when(F.size("sentences") > 1, F.col("first_lang")).otherwise(F.col("lang")))
    refused, lang, want, own = (F.col(c) for c in ("refused", "lang", "want", "own"))
    low = F.col("low")
    concedes = F.when(refused, low.rlike(CONCESSION))
    # sentences left when those that decline, apologise or are polite are taken out; looked at only where something declines
    polite = APOLOGY + r"|^(is there|let me know|ほかに|다른 |gibt es|haben sie|avez-vous|thank)"
    content = F.filter("sentences", lambda x: (F.length(squeeze(x)) > 0) & ~declines(F.lower(x)) & ~F.lower(x).rlike(polite))
    a = a.withColumn("content", F.when(refused, F.size(content)).otherwise(F.size("sentences")))
    stripped = F.when(F.length("qq") > 0, F.replace("sq", "qq", F.lit(""))).otherwise(F.col("sq"))
    asked = F.length("qq") >= 8
    marked = F.col("line").rlike(r"^\s*(?:[-*+•|>]|\d+[.)]\s|```|#)")
    ended = F.col("bare").rlike(r"[.!?。！？][\"'”’»)\]]*$") & ~F.col("bare").rlike(r"(?<!\.)\.\.\.$|…$")
    brief = (F.length("bare") <= 24) & ~F.col("bare").contains("\n")
    fences = F.regexp_count(F.col("bare"), F.lit("```")) % 2
    long_enough = F.length("sq") >= 12
    # whole texts; the difference of their lengths bounds the distance from below, so few pairs are compared
    near = F.when(F.abs(F.length("sq") - F.length("qq")) <= 0.1 * F.length("qq"), F.expr("levenshtein(sq, qq, int(0.1 * length(qq))) >= 0")).otherwise(False)
    share = F.col("ends") / F.greatest("times", F.lit(1))
    return a.select(
        "answer_id",
        vote(~filled, F.length("sq") > 12).alias("empty_nothing"),
        vote(low.rlike(rf"^[\[\](){{}}<>\"'*_.\s-]*({PLACEHOLDERS})?[\[\](){{}}<>\"'*_.\s-]*$"), F.length("sq") > 12).alias("empty_placeholder"),
        vote(low.rlike(rf"^({LABELS})?\s*[:：]?$"), F.length("sq") > 12).alias("empty_label"),
        F.when(asked & filled, vote(F.col("sq") == F.col("qq"))).alias("copy_equal"),
        F.when(asked & filled, vote((stripped == "") | ((F.length(stripped) < 0.1 * F.length("sq")) & F.col("sq").contains(F.col("qq"))))).alias("copy_rest"),
        F.when(asked & filled, vote(near | (stripped == ""))).alias("copy_near"),
        vote(refused & ~concedes, ~refused).alias("refusal_phrase"),
        F.when(filled, vote(refused & (F.col("content") == 0), F.col("content") >= 2)).alias("refusal_rest"),
        F.when(refused | F.substring(low, 1, LONGEST_APOLOGY).rlike(APOLOGY), vote((F.length("bare") <= SHORT) & (F.col("content") <= 1) & refused, F.length("bare") > SHORT)).otherwise(-1).cast("int").alias("refusal_short"),
        F.when(long_enough & lang.isNotNull() & want.isNotNull(), vote(lang != want)).alias("language_whole"),
        F.when(long_enough & F.col("first_lang").isNotNull() & want.isNotNull(), vote(F.col("first_lang") != want)).alias("language_first"),
        F.when(long_enough & lang.isNotNull() & want.isNotNull() & (own == want), vote(lang != own)).alias("language_script"),
        F.when(filled, F.when(ended, -1).when(marked | brief | (fences == 0) & F.col("bare").endswith("```"), None).otherwise(1)).cast("int").alias("truncated_mark"),
        F.when(filled & ~ended & ~brief & ~F.col("bare").endswith("```") & ~F.col("line").rlike(r"^\s*\|.*\|$"), vote((F.col("times") - F.col("ends") < 3) & (F.col("ends") == 0) | (share < 0.01), share >= 0.04)).alias("truncated_word"),
        F.when(filled, F.when(F.col("answer").rlike(r"[,;:(\[「]\s*$|\p{L}[-‐]\s*$") | (fences == 1) | F.col("line").rlike(r"^\s*\|.*[^|\s]\s*$") | (F.col("answer").rlike(r"[\p{L}\p{N}]\s+$") & ~brief), 1).when(ended, -1)).cast("int").alias("truncated_form"),
    )


def functions_of(columns: list[str]) -> dict[str, list[str]]:
    return {d: [c for c in columns if c.startswith(d + "_")] for d in DEFECTS}


def _weights(functions: list[str], rate: float, right: dict) -> callable:
    def posterior(pattern: tuple) -> float:
        yes, no = math.log(rate), math.log(1 - rate)
        for f, v in zip(functions, pattern):
            if v is None:  # an abstention is no evidence
                continue
            yes += math.log(right[f][1][v])
            no += math.log(right[f][0][v])
        return 1 / (1 + math.exp(min(700, no - yes)))

    return posterior


def fit(patterns: list[tuple[tuple, int]], functions: list[str], rounds: int = 60, prior: float = 40.0):
    """Rate and vote probabilities of one defect from pattern counts, by expectation-maximization with Dirichlet priors."""
    values = (1, -1)
    start = {1: {1: 0.9, -1: 0.1}, 0: {1: 0.03, -1: 0.97}}
    rate, right = 0.05, {f: {k: dict(v) for k, v in start.items()} for f in functions}
    total = sum(n for _, n in patterns) or 1
    for _ in range(rounds):
        posterior = _weights(functions, rate, right)
        soft = [(p, n, posterior(p)) for p, n in patterns]
        mass = sum(n * w for _, n, w in soft)
        rate = min(0.5, max(1e-4, (mass + 1) / (total + 20)))
        for i, f in enumerate(functions):
            for k in (0, 1):
                sums = {v: prior * start[k][v] for v in values}
                for p, n, w in soft:
                    if p[i] is not None:
                        sums[p[i]] += n * (w if k else 1 - w)
                all_ = sum(sums.values())
                right[f][k] = {v: x / all_ for v, x in sums.items()}
    return rate, right


def best_cutoff(scored: list[tuple[float, int]]) -> float:
    """The posterior from which on keeping has the best expected F1."""
    expected, kept, hit, best, cutoff = sum(w * n for w, n in scored), 0, 0.0, -1.0, 0.5
    for w, n in sorted(scored, reverse=True):
        kept, hit = kept + n, hit + w * n
        if (f1 := 2 * hit / (kept + expected)) > best + 1e-12 and w >= 0.5:
            best, cutoff = f1, w
    return min(cutoff, 0.95)


def label(voted: DataFrame) -> DataFrame:
    """``answer_id``, the posterior of every defect, ``defects`` (those above their cutoffs) and ``found`` (the first of them, or null)."""
    by = functions_of(voted.columns)
    out = voted
    half = F.pmod(F.xxhash64("answer_id"), F.lit(2)).alias("half")
    for defect, functions in by.items():
        # at most 3^len(functions) patterns in either half
        rows = voted.groupBy(half, *functions).count().collect()
        patterns = {h: [(tuple(r[f] for f in functions), r["count"]) for r in rows if r["half"] == h] for h in (0, 1)}
        rate, right = fit(patterns[0] or patterns[1], functions)
        posterior = _weights(functions, rate, right)
        cutoff = best_cutoff([(posterior(p), n) for p, n in patterns[1] or patterns[0]])
        yes, no = F.lit(math.log(rate)), F.lit(math.log(1 - rate))
        for f in functions:
            for k in (0, 1):
                part = F.when(F.col(f).isNull(), 0.0).when(F.col(f) > 0, math.log(right[f][k][1])).otherwise(math.log(right[f][k][-1]))
                yes, no = (yes + part, no) if k else (yes, no + part)
        out = out.withColumn(defect, F.round(1 / (1 + F.exp(no - yes)), 6)).withColumn(f"{defect}_cut", F.lit(cutoff - 1e-6))
    kept = F.filter(F.array(*[F.when(F.col(d) >= F.col(f"{d}_cut"), d) for d in DEFECTS]), lambda x: x.isNotNull())
    return out.select("answer_id", *DEFECTS, kept.alias("defects")).withColumn("found", F.try_element_at("defects", F.lit(1)))


def defects(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Every answer with its posteriors, defects and the one defect that is named; sound answers have none.

    A null, blank or placeholder answer is ``empty``. An answer whose question is missing or blank is judged without it: it is no copy and
    has no wanted language. Repeated answers are each judged. Extra columns are ignored.
    """
    return label(materialize(votes(answers, questions), "votes"))
