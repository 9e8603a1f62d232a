"""Random flows: what an execution reads is what the renamed facts say."""

import random

from tuplewright.plans import ssa


def flows(rng, count):
    """instruction, jump, ends, assigns, uses of random methods."""
    instruction, jump, ends, assigns, uses = [], [], [], [], []
    for m in range(count):
        n = rng.randint(3, 12)
        name = f"m{m}"
        for i in range(n):
            instruction.append((name, i))
            if rng.random() < 0.3:
                jump.append((name, i, rng.randrange(1, n)))
            if rng.random() < 0.1:
                ends.append((name, i))
            if rng.random() < 0.6:
                assigns.append((name, i, rng.choice("xyz")))
            uses += [(name, i, v) for v in "xyz" if rng.random() < 0.6]
    return instruction, jump, ends, assigns, uses


def test_executions_read_what_the_names_say(spark):
    rng = random.Random(4)
    instruction, jump, ends, assigns, uses = flows(rng, 25)
    frame = lambda given, schema: spark.createDataFrame(given, schema)
    facts = {
        "instruction": frame(instruction, "m string, i long"),
        "jump": frame(jump, "m string, i long, to long"),
        "ends": frame(ends, "m string, i long"),
        "assigns": frame(assigns, "m string, i long, v string"),
    }
    use_rows = frame(uses, "m string, i long, v string")
    names = ssa.renamed(spark, facts, use_rows)
    use = {(r.m, r.i, r.v): r.name for r in names["Use"].collect()}
    definition = {(r.m, r.i): (r.v, r.name) for r in names["Definition"].collect()}
    phi = {}
    for r in names["Phi"].collect():
        phi.setdefault((r.m, r.b), {})[r.v] = r.name
    argument = {(r.m, r.b, r.v, r.p): r.name for r in names["PhiArgument"].collect()}
    assert len(definition) == len({n for (m, _), (_, n) in definition.items() for n in [(m, n)]})
    last = {m: max(i for x, i in instruction if x == m) for m in {x for x, _ in instruction}}
    stops, jumps = set(ends), {}
    for m, i, to in jump:
        jumps.setdefault((m, i), []).append(to)
    leaders = {(m, 0) for m in last} | {(m, to) for m, _, to in jump} | {(m, i + 1) for m, i, _ in jump} | {(m, i + 1) for m, i in ends}
    read = through_phi = 0
    for m in last:
        for _ in range(40):
            i, block, came, env = 0, 0, None, {}
            for _ in range(60):
                if (m, i) in leaders and (came is not None or i == 0):
                    block, before = i, block
                    for v, name in phi.get((m, i), {}).items():
                        if came is not None:
                            assert argument[m, i, v, before] == env.get(v, f"{v}_0"), (m, i, v)
                            through_phi += 1
                    env |= {v: n for v, n in phi.get((m, i), {}).items() if came is not None}
                for v in "xyz":
                    if (m, i, v) in use:
                        assert use[m, i, v] == env.get(v, f"{v}_0"), (m, i, v)
                        read += 1
                if (m, i) in definition:
                    v, name = definition[m, i]
                    env[v] = name
                after = list(jumps.get((m, i), [])) + ([i + 1] if i < last[m] and (m, i) not in stops else [])
                if not after:
                    break
                came, i = i, rng.choice(after)
    assert read > 1000 and through_phi > 300
    facts_out = ssa.rewritten(use_rows.withColumn("row", use_rows.i * 2), names, "m", "i", uses=("v",))
    assert facts_out.columns == ["m", "i", "v", "row"]
    assert sorted(map(tuple, facts_out.collect())) == sorted((m, i, n, i * 2) for (m, i, v), n in use.items())
