import plain

from curricle.llm import quality_rules as m

TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "w " * 19,
    "a b c d e f g h " * 3,
    " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(9)),
    "x\ny\nx\n\nx \ny" + " z" * 30,
    "LOUD WORDS " * 15 + "soft",
    "é# ü$ %&|<>* " * 10,
    "go go go stop " * 12,
    "long" * 100 + " " + " ".join(f"v{i}" for i in range(40)),
    "first\x0bsecond\x0cthird\rfourth\x85fifth",
    " ".join(f"word{i}" for i in range(20_000)) + " w" * 30,
]


def test_measures_bits_and_verdicts(spark):
    rows = [(i, text, 7, "m") for i, text in enumerate(TEXTS)] + [(None, TEXTS[6], 1, "m"), (6, TEXTS[6], 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failures int, w string")
    got = m.judge(m.quality_ledger(docs)).collect()
    assert len(got) == len(rows)
    bits = {rule.bit: rule.name for rule in m.RULES}
    for row in got:
        text = TEXTS[6 if row.doc_id is None else row.doc_id]
        values, failed = plain.quality(text)
        assert {name: row[name] for name in values} == values
        assert {bits[b] for b in bits if row.failures >> b & 1} == failed
        assert row.base_failed == bool(failed & {"few_words", "repeated_windows"})
        assert row.kept == (not failed)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = m.quality_ledger(docs)
    found = {i: plain.quality(t)[1] for i, t in enumerate(TEXTS)}
    for row in m.ablation(ledger).collect():
        policy = {r.name for r in m.RULES if m.POLICIES[row.policy] >> r.bit & 1}
        assert row.n_failed == sum(row.rule in f for f in found.values())
        assert row.n_only == sum(f & policy == {row.rule} for f in found.values())
        assert row.n_rejected == sum(bool(f & policy) for f in found.values())
    for version, mask in m.POLICIES.items():
        policy = {r.name for r in m.RULES if mask >> r.bit & 1}
        kept = {r.doc_id for r in m.judge(ledger, version).filter("kept").collect()}
        base = {"few_words", "repeated_windows"}
        assert kept == {i for i, f in found.items() if not f & (policy | base)}
    assert m.ablation(ledger.limit(0)).count() == 0


def test_whole_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, kept string")
    row = m.judge(m.quality_ledger(docs, whole_rows=True)).first()
    assert (row.document.kept, row.kept) == ("x", False)
