import datetime
import hashlib
import re

from tests.llm import cases

from tuplewright.llm import pii

KEY = "k1"


def digest(kind, i, other):
    return hashlib.sha256(f"{KEY}|{kind}|{i}|{other}".encode()).hexdigest()


def chars(value, kind):
    h = len(value) // 2
    s = [value[:h], value[h:]]
    for i in range(pii.ROUNDS):
        d, out = digest(kind, i, s[1 - i % 2]), ""
        for j, c in enumerate(s[i % 2]):
            by = int(d[2 * j : 2 * j + 2], 16)
            for first, n, p in ((48, 10, "[0-9]"), (97, 26, "[a-z]"), (65, 26, "[A-Z]")):
                if re.match(p, c):
                    c = chr((ord(c) - first + by) % n + first)
                    break
            out += c
        s[i % 2] = out
    return s[0] + s[1]


def number(x, kind, a, b):
    s = [x // b, x % b]
    for i in range(pii.ROUNDS):
        s[i % 2] = (s[i % 2] + int(digest(kind, i, s[1 - i % 2])[:12], 16)) % (a, b)[i % 2]
    return s[0] * b + s[1]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_values_stay_in_their_format(spark):
    values = ["ab.42@mail8.example.com", "4041894974608795", "4041 8949 7460 8795", "217.94.102.185", "+1 (279) 555-0216", "123-45-6789", "2024-02-29", "02/29/2024", "29.02.2024", "4041894974608796", "2023-02-29", "999.1.1.1", "000-12-1234", "v1.2.3.4", "4.0.", "+49 30 1234567"]
    text = "Start " + " and ".join(values) + " end, 12 34. 4041894974608795\n"
    df = spark.createDataFrame([(1, text), (2, values[1]), (3, None), (4, ""), (5, "no digits")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    new = got[1].text[6:].split(" end,")[0].split(" and ")
    assert new[0] == chars("ab.42", "email") + "@mail8.example.com"
    assert new[1] == got[2].text and luhn(new[1]) and new[1][:-1] == chars(values[1][:-1], "card") != values[1][:-1]
    assert new[2].replace(" ", "") == new[1] and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new[2])
    assert new[3] == ".".join(map(str, number(int.from_bytes(map(int, values[3].split("."))), "ip", 65536, 65536).to_bytes(4)))
    assert new[4] == "+1" + chars(values[4][2:], "phone") and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[4])
    n = number(((123 - 1) * 99 + 44) * 9999 + 6788, "ssn", 898, 99 * 9999)
    area = n // (99 * 9999)
    assert new[5] == f"{area + (2 if area >= 665 else 1):03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    first = datetime.date(1700, 1, 1)
    day = first + datetime.timedelta(number((datetime.date(2024, 2, 29) - first).days, "date", 27, 5411))
    assert new[6:9] == [day.strftime(f) for f in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")]
    assert new[9:15] == values[9:15] and new[15] != values[15]
    assert got[1].text.endswith("end, 12 34. " + new[1] + "\n")
    assert got[1].pii.asDict() == {"email": 1, "card": 3, "ip": 1, "phone": 2, "ssn": 1, "date": 3}
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "no digits") and sum(got[3].pii) == 0


def test_cards_beside_other_numbers(spark):
    card, longest = "4111111111111111", "6304123456789012345"
    longest = next(longest[:-1] + d for d in "0123456789" if luhn(longest[:-1] + d))
    new = lambda c: (lambda b: b + next(d for d in "0123456789" if luhn(b + d)))(chars(c[:-1], "card"))
    in4 = lambda c: " ".join(c[i : i + 4] for i in range(0, len(c), 4))
    amex = "3782 822463 10005"
    put = lambda a: (lambda b: f"{b[:4]} {b[4:10]} {b[10:]}")(new(a.replace(" ", "")))
    cases_ = [
        (f"{in4(card)} 05/27", f"{in4(new(card))} 05/27", 1),
        (f"12 {card}", f"12 {new(card)}", 1),
        (f"{card} 123", f"{new(card)} 123", 1),
        (f"2024 {in4(card)} 77", f"2024 {in4(new(card))} 77", 1),
        (f"12 {in4(card).replace(' ', '-')} 345", f"12 {in4(new(card)).replace(' ', '-')} 345", 1),
        (f"7 {amex} 1234", f"7 {put(amex)} 1234", 1),
        (in4(longest), in4(new(longest)), 1),
        (f"{in4(card)} {in4(card)}", f"{in4(new(card))} {in4(new(card))}", 2),
        (f"{card} 12 {card}", f"{new(card)} 12 {new(card)}", 2),
        ("1234 5678 9012 3456 78", "1234 5678 9012 3456 78", 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases_)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    assert [(got[i].text, got[i].pii.card) for i in range(len(cases_))] == [(c[1], c[2]) for c in cases_]
    df = spark.createDataFrame([(1, f"{card} 02/29/2024"), (2, f"{card} 10.0.0.1")], "doc_id long, text string")
    got = {r.doc_id: r.pii.asDict() for r in pii.pseudonymise(df, KEY).collect()}
    assert (got[1]["card"], got[1]["date"], got[2]["card"], got[2]["ip"]) == (1, 1, 1, 1)


def found_by_hand(run, fresh=True):
    """A run of digit groups with its cards replaced, group by group, and how many there are."""
    groups, seps = re.split("[ -]", run), [*re.findall("[ -]", run), ""]
    out, n, i = "", 0, 0
    while i < len(groups):
        spans = []
        for j in range(i + 1, len(groups) + 1):
            part, between = groups[i:j], set(seps[i : j - 1])
            digits, shape = "".join(part), [len(g) for g in part]
            if len(digits) > 19:
                break
            one = len(between) == 1
            common = j == i + 1 or one and (shape == [4, 6, 5] or shape == [4] * 4 or len(shape) == 5 and shape[:4] == [4] * 4 and shape[4] <= 3)
            if len(digits) >= 13:
                spans.append((j, digits, common))
        loose = spans[-1:] if fresh else []
        order = [[4] * 5, [4] * 4, [4, 6, 5]]
        rank = lambda s: order.index([4] * 5 if s[0] - i == 5 else [len(g) for g in groups[i : s[0]]]) if s[0] > i + 1 else -1
        hit = next((s for s in loose + sorted((s for s in spans if s[2]), key=rank) if luhn(s[1])), None)
        fresh = hit is not None
        j = hit[0] if hit else i + 1
        text = "".join(g + s for g, s in zip(groups[i:j], seps[i:j], strict=True))
        if hit:
            body = chars(hit[1][:-1], "card")
            digits = iter(body + next(d for d in "0123456789" if luhn(body + d)))
            text, n = "".join(next(digits) if c.isdigit() else c for c in text), n + 1
        out, i = out + text, j
    return out, n


def test_cards_in_runs_of_any_length(spark):
    import random

    draw = random.Random(5)
    card = "4111 1111 1111 1111"
    runs = ["1234 " * k + card for k in (13, 14, 15, 16, 300)] + [f"{'7 ' * 600}{card}{' 8' * 600}", "1" * 70 + " " + card, f"{card} " * 150 + "9"]
    for _ in range(60):
        groups = ["".join(draw.choices("0123456789", k=draw.choice([1, 2, 4, 4, 4, 5, 6, 16, 25]))) for _ in range(draw.randrange(14, 90))]
        for at in draw.sample(range(len(groups)), 3):
            groups[at] = draw.choice([card, card.replace(" ", "-"), card.replace(" ", ""), "3782 822463 10005"])
        run = "".join(g + draw.choice("  -") for g in groups)[:-1]
        if not re.search("|".join(pii.FORMATS[k] for k in ("ssn", "date")), run):
            runs.append(run)
    df = spark.createDataFrame([(i, f"no. {r}; end") for i, r in enumerate(runs)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    for i, r in enumerate(runs):
        text, n = found_by_hand(r)
        assert (got[i].text, got[i].pii.card) == (f"no. {text}; end", n), r
    assert all("4111 1111 1111 1111" not in got[i].text for i in range(8)) and len(runs) > 50


def test_cards_beside_punctuation_and_letters(spark):
    card = "4111111111111111"
    body = chars(card[:-1], "card")
    new = body + next(d for d in "0123456789" if luhn(body + d))
    in4 = lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4))
    beside = ["card-{}", "no.{}", "{}-", "-{}-", "({})", "{}.", "a.{}, b", "x {}-y", "{} 12ab", "{}-12ab", "{} 123-45-67890", "{} 1-2-", "{}\n{}"]
    plain = ["x{}", "{}x", "0.{}", "3.{}", "_{}", "{}_1"]
    given = [(t.format(*[c] * t.count("{}")), t.format(*[n] * t.count("{}"))) for t in beside for c, n in ((card, new), (in4(card, " "), in4(new, " ")), (in4(card, "-"), in4(new, "-")))]
    given += [(t.format(card),) * 2 for t in plain]
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    assert [got[i] for i in range(len(given))] == [g[1] for g in given]


def test_a_very_long_run_takes_time_in_proportion(spark):
    run = "4111 1111 1111 1111 12 " * 20_000 + "5"
    df = spark.createDataFrame([(1, run), (2, "7" * 500_000), (3, "7" * 500_000 + "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    text, n = found_by_hand(run)
    assert (got[1].text, got[1].pii.card) == (text, n) and n == 20_000
    assert got[2].text == "7" * 500_000 and got[3].text == "7" * 500_000 + "a"


def test_permutations_are_one_to_one(spark):
    df = spark.range(27 * 50).select(pii.permute_number(pii.F.col("id"), pii.F.lit(KEY), "x", 27, 50).alias("n"))
    assert sorted(r.n for r in df.collect()) == list(range(27 * 50))
    df = spark.range(1000).select(pii.permute_characters(pii.F.lpad(pii.F.col("id").cast("string"), 3, "0"), pii.F.lit(KEY), "x").alias("s"))
    assert len({r.s for r in df.collect()}) == 1000


def test_query_bears_the_cases(spark, tmp_path):
    folder = cases.stored(spark, tmp_path)
    got = pii.op6_pii(spark, folder)
    assert not any("Python" in x or "Arrow" in x for x in got._jdf.queryExecution().executedPlan().toString().split())
    rows = got.collect()
    texts = {r[0]: r[1] for r in cases.rows()}
    assert len(rows) == len(cases.rows()) and all(r.text == texts[r.doc_id] for r in rows)


def test_empty(spark, tmp_path):
    assert pii.op6_pii(spark, cases.stored(spark, tmp_path, [])).count() == 0


def test_dates_in_other_forms(spark):
    first = datetime.date(1700, 1, 1)

    def new(day, walk=False):
        while True:
            day = first + datetime.timedelta(number((day - first).days, "date", 27, 5411))
            if not walk or day.day > 12:
                return day

    day = datetime.date(2024, 3, 5)
    far = new(datetime.date(2024, 1, 13), True)
    short = lambda d, f: f.format(y=d.year, m=d.month, d=d.day)
    given = {
        "2024-03-05T10:00:00": f"{new(day)}T10:00:00",
        "2024-3-5": short(new(day), "{y}-{m}-{d}"),
        "3/5/2024": short(new(day), "{m}/{d}/{y}"),
        "5.3.2024": short(new(day), "{d}.{m}.{y}"),
        "13/01/2024": far.strftime("%d/%m/%Y"),
        "13/1/2024": short(far, "{d}/{m}/{y}"),
        "13/13/2024": "13/13/2024",
        "31.2.2024": "31.2.2024",
    }
    df = spark.createDataFrame([(i, f"on {t}, yes") for i, t in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    assert [got[i] for i in range(len(given))] == [f"on {t}, yes" for t in given.values()]


def test_query_replaces_values_by_the_sessions_key(spark, tmp_path):
    texts = {1: "write to ab.42@mail8.example.com or 123-45-6789 on 2024-02-29", 2: "4041894974608795 and 4041894974608795", 3: "call +1 (279) 555-0216"}
    folder = cases.stored(spark, tmp_path, [(i, t, None, None, 0, 0, "", "", 0) for i, t in texts.items()])
    before = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.set(pii.KEY_SETTING, KEY)
        got = {r.doc_id: r for r in pii.op6_pii(spark, folder).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    day = datetime.date(1700, 1, 1) + datetime.timedelta(number((datetime.date(2024, 2, 29) - datetime.date(1700, 1, 1)).days, "date", 27, 5411))
    n = number(((123 - 1) * 99 + 44) * 9999 + 6788, "ssn", 898, 99 * 9999)
    area = n // (99 * 9999)
    ssn = f"{area + (2 if area >= 665 else 1):03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    assert got[1].text == f"write to {chars('ab.42', 'email')}@mail8.example.com or {ssn} on {day}"
    body = chars("404189497460879", "card")
    card = next(body + d for d in "0123456789" if luhn(body + d))
    assert got[2].text == f"{card} and {card}" and got[2].n_card == 2
    assert got[3].text == "call +1" + chars(" (279) 555-0216", "phone")
    drawn = pii.session_key(spark)
    assert len(drawn) == 64 and pii.session_key(spark) == drawn and drawn != KEY
    if before:
        spark.conf.set(pii.KEY_SETTING, before)


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", 5, 6)], "doc_id long, text string, pii int, _new int")
    out = pii.pseudonymise(df, KEY)
    (row,) = out.collect()
    assert out.columns == ["doc_id", "text", "pii", "_new", "pii_"] and (row.pii, row._new, row.pii_.email) == (5, 6, 1)
