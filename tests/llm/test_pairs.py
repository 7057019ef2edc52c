from foliant.llm import pairs as P

Q = "How many days does the registrar have to renew the copy?"
GOOD = "The registrar has {} days to renew the copy under the statute. The notice is deemed complete once it has been signed."
CASES = {
    "": "empty", "N/A": "empty", "답변:": "empty", "​": "empty", "<p></p>": "empty", Q: "copy", Q.lower() + "  ": "copy", f"{Q} {Q}": "copy", f'"{Q}"': "copy",
    "I'm sorry, but I can't help with that request.": "refusal", "Sorry, this is something I won't answer. Is there anything else you would like to know?": "refusal",
    "등기관은 사본을 갱신하여야 한다. 사본은 서명으로 완성된 것으로 본다.": "language", GOOD.format(3)[:-30]: "truncated", GOOD.format(3) + " Users may req": "truncated",
    "Yes.": None, "92 days.": None, "Section 16": None, "Sorry for the long answer. " + GOOD.format(7): None, "I can't see the appendix, yet the main page gives the answer. " + GOOD.format(8): None,
    GOOD.format(9) + "\n\n```python\nx = 1\n```": None, f"{Q}\n\n{GOOD.format(5)}": None,
}


def test_cases(spark):
    texts = list(CASES) + [GOOD.format(i) for i in range(300)] + [GOOD.format(i)[:-25] for i in range(12)] + ["None", "", "I cannot provide an answer."] * 6
    rows = [(i, "q", t) for i, t in enumerate(texts)] + [(9001, "absent", "A sound answer without a question, to be sure."), (9002, "q", None), (9003, "k", "등기관은 사본을 갱신하여야 한다. 사본은 서명으로 완성된 것으로 본다.")]
    answers = spark.createDataFrame([(*r, "x") for r in rows], "answer_id long, query_id string, answer string, found string")
    questions = spark.createDataFrame([("q", Q, 1), ("k", Q + " Please answer in Korean.", 1), ("n", None, 1)], "query_id string, text string, answer int")
    got = {r.answer_id: r.found for r in P.defects(answers, questions).collect()}
    wrong = [(t, got[i], CASES[t]) for i, t in enumerate(CASES) if got[i] != CASES[t]]
    assert not wrong, wrong
    assert got[9001] is None and got[9002] == "empty" and got[9003] is None and len(got) == len(rows)
    assert P.defects(answers.limit(0), questions).count() == 0


def test_label_model_finds_the_better_function():
    # f1 is right nine times in ten, f2 six times; the posterior follows f1
    patterns = [((1, 1), 54), ((1, -1), 36), ((-1, 1), 40), ((-1, -1), 870)]
    rate, right = P.fit(patterns, ["f1", "f2"])
    posterior = P._weights(["f1", "f2"], rate, right)
    assert posterior((1, -1)) > posterior((-1, 1)) and posterior((1, 1)) > 0.9 > 0.1 > posterior((-1, -1)) and posterior((None, None)) < 0.5
