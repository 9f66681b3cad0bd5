import itertools
import random

from curricle.llm import role_repair as m

NAMES = ("", *m.ROLES)


def cheapest(roles, costs):
    """Brute force: the least cost over all repaired sequences."""
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            state, total = 0, 0
            for role, to, merge in zip(roles, states, merged, strict=True):
                if role not in m.ROLES:
                    total += costs.unknown
                elif role != NAMES[to]:
                    total += costs.relabel
                if merge:
                    if to != state:
                        break
                    total += costs.merge
                elif to not in m.LEGAL[state]:
                    if not any(to in m.LEGAL[x] for x in m.LEGAL[state]):
                        break
                    total += costs.insert
                state = to
            else:
                total += m.final_costs(costs)[state] if roles else 0
                best = total if best is None else min(best, total)
    return best


def cost_of(rows, costs):
    total = 0
    for r in rows:
        total += {"keep": 0, "merge": costs.merge, "insert": costs.insert}[r.action]
        total += costs.unknown if r.role not in m.ROLES else costs.relabel * (r.role != r.new_role)
    return total + m.final_costs(costs)[m.ROLES.index(rows[-1].new_role) + 1]


def rendered_roles(text):
    return [part.split("\n", 1)[0] for part in text.split("<|im_start|>")[1:]]


def is_legal(roles):
    state = 0
    for role in roles:
        to = NAMES.index(role)
        if to not in m.LEGAL[state]:
            return False
        state = to
    return state == m.ASSISTANT


def test_costs_are_least_and_rendering_is_legal(spark):
    random.seed(2)
    kinds = ["system", "user", "assistant", "tool", None]
    convs = {c: [random.choice(kinds) for _ in range(random.randrange(1, 6))] for c in range(150)}
    rows = [(c, t, role, f"text {c} {t}", "x") for c, roles in convs.items() for t, role in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part string")
    for costs in (m.Costs(), m.Costs(merge=3, insert=1, relabel=1, unknown=0)):
        got = m.repair_conversations(turns.repartition(4), costs=costs).collect()
        assert len(got) == len(rows)
        for c, roles in convs.items():
            mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
            assert [r.position for r in mine] == list(range(len(roles)))
            assert [r.turn for r in mine] == list(range(len(roles)))
            assert cost_of(mine, costs) == cheapest(roles, costs)
            text = "".join(r.fragment for r in mine)
            assert is_legal(rendered_roles(text)), text
            assert all(f"text {c} {t}" in text for t in range(len(roles)))


def test_a_conversation_over_many_partitions_equals_one(spark):
    random.seed(4)
    roles = [random.choice(["user", "assistant", "system", "x"]) for _ in range(3000)]
    rows = [(7, t, role, f"t{t}") for t, role in enumerate(roles)] + [(8, 0, "user", "a"), (9, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    got = sorted((r for r in m.repair_conversations(turns).collect() if r.conv_id == 7), key=lambda r: r.position)
    repair = m.Repair(m.Costs())
    states = repair.borders([repair.matrix(roles)])
    plain = repair.path(roles, *states)
    assert [r.new_role for r in got] == [m.ROLES[s - 1] for s in plain]
    assert is_legal(rendered_roles("".join(r.fragment for r in got)))


def test_nulls_ties_and_empty_table(spark):
    rows = [
        (None, None, None, None),
        (None, None, None, None),
        (1, 0, " User ", "a"),
        (1, 0, "user", "b"),
        (2, 0, "user", "y" * 500_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted(m.repair_conversations(turns).collect(), key=lambda r: (r.conv_id or 0, r.position))
    assert [(r.conv_id, r.position) for r in got] == [(None, 0), (None, 1), (1, 0), (1, 1), (2, 0)]
    assert "".join(r.fragment for r in got if r.conv_id == 2).endswith("<|im_start|>assistant\n<|im_end|>\n")
    assert m.repair_conversations(turns.limit(0)).count() == 0
