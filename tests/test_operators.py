"""Operators against small restatements of their formulas, and their gates against bad input."""

import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import envelope as E
from weftline.functions import expr as X
from weftline.operators import allocate as A
from weftline.operators import calibrate, dedup, gates, replay, usage
from weftline.operators import outcomes as O
from weftline.operators import select as S
from weftline.sources import records, shared


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_canonical_json_is_pythons(spark):
    texts = ["", "é中😀", 'q"\\/', "\x00\x01\x1f\x7f\n\t", " "]
    for t in texts:
        got = one(spark, X.canonical_json(F.struct(F.lit(True).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(t).alias("c"))))[0]
        assert got == json.dumps({"a": True, "b": None, "c": t}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_fingerprint_ignores_ids_and_order(spark):
    context = {"applicationCategory": "mail"}
    a = [{"id": "1", "text": "x\x1f"}, {"id": "2", "text": "y"}]

    def hashes(entries):
        df = spark.createDataFrame([(context, entries)], "context struct<applicationCategory:string>, entries array<struct<id:string,text:string>>")
        return df.select(X.content_fingerprint(F.col("context"), F.col("entries")).alias("c"), X.visible_sha256(F.col("context"), F.col("entries")).alias("v")).first()

    x, y, z = hashes(a), hashes([{"id": "9", "text": "y"}, {"id": "8", "text": "x\x1f"}]), hashes([{"id": "1", "text": "x"}, {"id": "2", "text": "y"}])
    dump = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    body = {"context": context, "entries": sorted(({"text": e["text"]} for e in a), key=dump)}
    assert x["c"] == hashlib.sha256(dump(body).encode()).hexdigest() == y["c"] != z["c"]
    assert x["v"] == hashlib.sha256(dump({"context": context, "entries": a}).encode()).hexdigest() != y["v"]


def test_wilson_and_sigmoid(spark):
    low, high = one(spark, *X.wilson(F.lit(8), F.lit(10)))
    assert (round(low, 6), round(high, 6)) == (0.490162, 0.943318)
    assert list(one(spark, *X.wilson(F.lit(0), F.lit(0)))) == [None, None]
    assert list(one(spark, X.sigmoid(F.lit(-800.0)), X.sigmoid(F.lit(800.0)), X.sigmoid(F.lit(0.0)))) == [0.0, 1.0, 0.5]


def test_utf16_and_strip(spark):
    t = F.lit("a😀b")
    got = one(spark, X.utf16_length(t), X.utf16_substring(t, F.lit(1), F.lit(2)), X.utf16_substring(t, F.lit(2), F.lit(1)), X.utf16_substring(t, F.lit(3), F.lit(2)), X.strip(F.lit("　 x  ")))
    assert list(got) == [4, "😀", None, None, "x"]


def test_failure_texts(spark):
    text = F.lit("error 429: your limit will reset in 2 minutes; your limit will reset in 30 seconds")
    assert list(one(spark, X.limit_signal(text), X.reset_countdown(text), X.limit_signal(F.lit("cost 1429")), X.reset_countdown(F.lit("none")))) == ["provider_error_contains_429", 120, None, None]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert list(one(spark, X.retry_after(F.lit("7"), now), X.retry_after(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), now), X.retry_after(F.lit("soon"), now), X.retry_after(F.lit("-3"), now))) == [7.0, 60.0, None, 0.0]


def test_application_category(spark):
    names = ["com.google.chrome", "com.google.chrome.beta", "com.google.chromex", "com.jetbrains.pycharm", "COM.APPLE.FINDER", "x"]
    assert list(one(spark, *[X.application_category(F.lit(n)) for n in names])) == ["browser", "browser", "unknown", "development", "file_management", "unknown"]


def test_envelope_render_round_trip(spark):
    none = F.lit(None).cast("string")
    near = F.array(F.lit(" n "), F.lit("n"), F.lit("m" * 300), F.lit("k" * 400), F.lit("o"))
    text = E.render(F.lit("a😀bc"), F.lit(3), F.lit(1), F.lit("b"), near)
    got = one(spark, text, E.is_valid(text), F.transform(E.parsed(text)["nearbyText"], F.length), E.render(F.lit(""), F.lit(0), F.lit(0), F.lit(""), F.array().cast("array<string>")))
    assert json.loads(got[0])["beforeSelection"] == "a😀" and json.loads(got[0])["afterSelection"] == "c" and list(json.loads(got[0])) == ["format", "selectionKnown", "beforeSelection", "afterSelection", "nearbyText"]
    assert list(got)[1:] == [True, [1, 240, 240], ""]
    lost = [E.render(F.lit("a😀b"), F.lit(s), F.lit(n), F.lit(x), F.array().cast("array<string>")) for s, n, x in ((2, 1, "b"), (0, 9, "a"), (0, 1, "z"))] + [E.render(F.lit("ab"), none.cast("int"), none.cast("int"), F.lit(""), F.array().cast("array<string>"))]
    assert all(json.loads(x)["selectionKnown"] is False for x in one(spark, *lost))


def test_nearby_texts_are_cut_to_what_is_left(spark):
    near = lambda *xs, host=None: E.nearby_texts(F.array(*map(F.lit, xs)), host)
    got = one(spark, near("a" * 240, "b" * 240, "c" * 240, "d"), near("Mail here", "mail", "mails", host="Mail"), near("1", "2", "3", "4", "5"), near("C++ x", host="C++"))
    assert [len(x) for x in got[0]] == [240, 240, 120] and list(got[1]) == ["here", "mails"] and list(got[2]) == ["1", "2", "3", "4"] and list(got[3]) == ["x"]


def brute_trim(sizes, total, fixed):
    sizes = list(sizes)
    while sum(sizes) + fixed > total and any(sizes):
        i = max(range(len(sizes)), key=lambda k: (sizes[k], -k))
        sizes[i] = max(0, sizes[i] - max(1, sum(sizes) + fixed - total))
    return sizes


def test_trim_of_the_longest(spark):
    rng = random.Random(3)
    data = [tuple(rng.randint(0, 30) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(data, "a int, b int, c int").coalesce(1)
    got = df.select("a", "b", "c", *[x.alias(f"t{i}") for i, x in enumerate(gates.trim_longest([F.col("a"), F.col("b"), F.col("c")], 31, 3))]).collect()
    for r in got:
        assert [r.t0, r.t1, r.t2] == brute_trim((r.a, r.b, r.c), 31, 3), r


def brute_actions(counts):
    total, out = sum(counts), [[0, 0, c] for c in counts]
    for k, share in ((0, 7), (1, 2)):
        for row, c in zip(out, counts, strict=True):
            row[k] = min(c * share // 10, row[2])
            row[2] -= row[k]
        left = (total * share + 5) // 10 - sum(r[k] for r in out)
        for i in sorted(range(len(counts)), key=lambda i: -(counts[i] * share % 10)):
            if left and out[i][2]:
                out[i][k] += 1
                out[i][2] -= 1
                left -= 1
    return out


def test_quotas(spark):
    rng = random.Random(1)
    for n in (1, 3, 8, 40):
        counts = [rng.randint(1, 60) for _ in range(n)]
        df = spark.createDataFrame([(f"f{i:02d}", i, c) for i, c in enumerate(counts)], "family string, ord int, count long")
        got = [[r["select"], r["no_match"], r["missing_intent"]] for r in A.action_quotas(df).orderBy("ord").collect()]
        assert got == brute_actions(counts)
    fam = spark.createDataFrame([(f"f{i}", i) for i in range(12)], "family string, ord int")
    r = A.action_quotas(A.family_quotas(fam, 3000)).collect()
    assert {(x["count"], x["select"], x["no_match"], x["missing_intent"]) for x in r} == {(250, 175, 50, 25)}


def test_cover_order():
    s = pd.DataFrame([(0, "a", 1), (1, "a", 2), (1, "b", 1), (2, "c", 5), (3, "b", 1)], columns=["position", "stratum", "n"])
    assert A.cover_order(s, {"a": 2, "b": 1}) == [1, 0, 3, 2]


def test_round_robin(spark):
    rows = [(f"g{i % 2}", f"f{i % 3}", i) for i in range(30)]
    got = S.round_robin(spark.createDataFrame(rows, "g string, f string, i int"), ["g"], ["f"], [F.col("i")], 4).collect()
    want = []
    for g in ("g0", "g1"):
        fams = {f: sorted(i for a, b, i in rows if a == g and b == f) for f in ("f0", "f1", "f2")}
        turns = [(k, f, x) for f, xs in fams.items() for k, x in enumerate(xs)]
        want += [x for _, _, x in sorted(turns)[:4]]
    assert sorted(r.i for r in got) == sorted(want)


def test_calibrator_matches_its_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=60) > 0).astype(int)
    got = calibrate.fit(spark.createDataFrame([(float(a), float(b), bool(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, t boolean"), [F.col("a"), F.col("b")], F.col("t")).first()
    z = np.column_stack(((x - x.mean(0)) / x.std(0), np.ones(60)))
    w = np.array([*got["coefficients"], got["intercept"]])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - w * [1, 1, 0]
    assert np.abs(gradient).max() < 1e-8
    with pytest.raises(ValueError):
        calibrate.fit(spark.createDataFrame([(1.0, True)], "a double, t boolean"), [F.col("a")], F.col("t"))


def test_ties_and_failures(spark):
    entries, label = [("a",), ("b",)], (None, ["b"], "select")
    rows = [("tie", entries, label, [("a", 0, 0.5), ("b", 1, 0.5)], 0.1, None), ("abstain", entries, label, [("a", 0, 0.5), ("b", 1, 0.4)], 0.5, None), ("short", entries, label, [("a", 0, 0.5)], 0.1, None), ("nan", entries, label, [("a", 0, float("nan")), ("b", 1, 0.1)], 0.1, None), ("error", entries, label, [("a", 0, 0.9), ("b", 1, 0.1)], 0.1, "timeout"), ("empty", [], (("no_match"), [], "abstain"), [], 0.1, None)]
    df = spark.createDataFrame(rows, "id string, entries array<struct<id:string>>, label struct<abstain_reason:string,acceptable_ids:array<string>,decision:string>, scores array<struct<id:string,pos:int,score:double>>, abstain_score double, error string")
    cal = {"mean": [0, 0, 0, 0], "scale": [1, 1, 1, 1], "coefficients": [0, 0, 0, 0], "intercept": 0, "threshold": 0.5}
    got = {r["id"]: r for r in O.with_outcome(O.with_decision(O.with_features(df, F.lit(False)), cal)).collect()}
    assert got["tie"]["top_id"] == "a" and got["tie"]["decision"] == "recommended" and not got["tie"]["correct_promotion"]
    assert got["abstain"]["decision"] == "abstain" and not got["abstain"]["correct_decision"]
    assert [got[k]["decision"] for k in ("short", "nan", "error", "empty")] == ["inference_failure"] * 3 + ["bypass"]
    assert got["error"]["failure"] and got["empty"]["correct_decision"]


def test_coverage_and_claims(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(1,), (3,)], "id long")
    assert {tuple(r) for r in dedup.coverage(a, b, "id").collect()} == {(2, 2, 0), (3, 0, 1)}
    with pytest.raises(dedup.CoverageError):
        dedup.require_coverage(a, b, "id")
    dedup.require_coverage(b, b, "id")


def test_sources_and_gates(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id":"a","x":1}\n\n{"id":"b","x":2}\n')
    bad.write_text('{"id":"a"}\n{"id":"a"}\n')
    assert records.read_jsonl(spark, str(good), "id string, x long").count() == 2
    with pytest.raises(records.ScanError):
        records.read_jsonl(spark, str(bad), "id string")
    with pytest.raises(records.ScanError):
        records.require_training_path("/data/heldout-v2/x.jsonl")
    fam = spark.createDataFrame([("train", "f")], "split string, family_id string")
    rows = spark.createDataFrame([("a", "f"), ("b", "g")], "id string, family_id string")
    assert records.guarded(rows.where("id = 'a'"), fam, "train").count() == 1
    for broken in (rows, rows.limit(0)):
        with pytest.raises(records.ScanError):
            records.guarded(broken, fam, "train")


def test_snapshot_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id long, lang string")
    path = f"file://{tmp_path}/snap"
    m = records.publish(rows, path, "id", ["lang"])
    again = records.publish(rows.orderBy("id"), f"file://{tmp_path}/other", "id", ["lang"])
    assert m == again and m["rows"] == 2 and m["lang"] == {"a": 1, "b": 1}
    with pytest.raises(FileExistsError):
        records.publish(rows, path, "id", ["lang"])
    assert sorted(r.value for r in spark.read.text(f"{path}/lines").collect()) == ['{"id":1,"lang":"a"}', '{"id":2,"lang":"b"}']
    f = f"file://{tmp_path}/m.json"
    assert [shared.write_immutable(spark, f, "x"), shared.write_immutable(spark, f, "x")] == ["published", "unchanged"]
    with pytest.raises(ValueError):
        shared.write_immutable(spark, f, "y")
    with pytest.raises(ValueError):
        shared.write_json(spark, f"file://{tmp_path}/n.json", {"a": float("nan")})
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/sub/x").write_bytes(b"x")
    assert [(r.path, r.sha256) for r in records.file_hashes(spark, str(tmp_path / "tree")).collect()] == [("sub/x", hashlib.sha256(b"x").hexdigest())]


def test_replay_finds_changes(spark):
    context = ("unknown", "", "", True, "text", False, "", "")
    schema = "id string, context struct<applicationCategory:string,fieldLabel:string,fieldRole:string,hasAccessibility:boolean,inputSurface:string,isSecure:boolean,selectedText:string,surroundingText:string>, entries array<struct<id:string,text:string>>"
    df = spark.createDataFrame([("a", context, [("1", "x")]), ("b", context, [("1", "y")])], schema)
    own = df.withColumn("preprocessing", F.struct(X.visible_sha256(F.col("context"), F.col("entries")).alias("visible_sha256")))
    prints = own.select("id", X.content_fingerprint(F.col("context"), F.col("entries")).alias("content_sha256"))
    assert replay.episodes(own, prints).count() == 0
    changed = own.withColumn("entries", F.when(F.col("id") == "b", F.array(F.struct(F.lit("1").alias("id"), F.lit("z").alias("text")))).otherwise(F.col("entries")))
    assert [tuple(r) for r in replay.episodes(changed, prints).collect()] == [("b", "visible_changed")]


def test_prefix_clip_by_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "short", "one two three four five six", "日本語の文字列です" * 3]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gates.clip_pieces("t", F.lit(5), F.lit(path)).alias("c")).collect()
    for r in got:
        assert r.t.startswith(r.c) and len(lib.encode(r.c)) <= 5 and (len(lib.encode(r.t)) > 5 or r.c == r.t)


def test_python_placement(spark):
    src = spark.createDataFrame([("x = 1",), ("x =",), ("def f(:",)], "s string")
    assert [r[0] for r in src.select(gates.compiles("s")).collect()] == [True, False, False]


def test_updates(spark):
    for n, epochs, batch, warm in ((5000, 2, 16, 0), (33, 2, 16, 7), (16, 1, 16, 1), (1, 3, 16, 5)):
        got = one(spark, *usage.updates(F.lit(n), F.lit(epochs), F.lit(batch), F.lit(warm)).values())
        sizes = [batch] * (n // batch) + ([n % batch] if n % batch else [])
        assert list(got) == [len(sizes), warm + len(sizes) * epochs, sum(sizes[i % len(sizes)] for i in range(warm)) + n * epochs]


def test_ranks_and_running_sums(spark):
    from weftline.operators.ranks import ranked

    rng = random.Random(2)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 9)) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "id long, g long, n long").repartition(7), [F.desc("g"), F.col("id")], sums={"total": "n"}).collect()
    want, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    for k, (r, (i, g, n)) in enumerate(zip(sorted(got, key=lambda r: r.position), want, strict=True)):
        total += n
        assert (r.id, r.g, r.n, r.position, r.total) == (i, g, n, k, total)
    assert ranked(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0


def test_literal_containment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SHORT_ITEMS", 3)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    texts = [(i, rng.choice(["", " ", "\n"]).join(word() + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None)]
    items = [(" ".join(word() for _ in range(rng.randint(1, 5))),) for _ in range(25)] + [("  a b ",), ("a  b  a",)]
    got = dedup.contained(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(items, "i string"), "k", "t", "i").collect()
    want = {(k, i) for k, t in texts if t for (i,) in items if i in t}
    assert {(r.k, r.i) for r in got} == want and len(got) == len(want)


def test_recent_events_across_spans(spark, monkeypatch):
    monkeypatch.setattr(usage, "SPAN", 2)
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), rng.randint(0, 40_000)) for _ in range(300)]
    log = spark.createDataFrame(rows, "k long, s long").withColumn("started_at", F.timestamp_seconds("s"))
    for r in usage.recent(log, "k", 3600).collect():
        assert r.recent == sum(k == r.k and 0 <= r.s - s <= 3600 for k, s in rows)


def test_claims_survive_a_restart(spark, tmp_path):
    from weftline.streaming import logs

    folder, place = f"file://{tmp_path}/in", f"file://{tmp_path}/claims"
    for k, rows in enumerate(([("a", 5), ("b", 6)], [("a", 1), ("c", 2)])):
        spark.createDataFrame([(*r, k) for r in rows], "digest string, owner long, arrival int").coalesce(1).write.mode("append").parquet(folder)
        got = logs.rolling_claims(logs.source(spark, folder, "digest string, owner long, arrival int", 1), "digest", "owner", "arrival", place)
    assert {r.digest: r.owner for r in got.collect()} == {"a": 5, "b": 6, "c": 2}  # a smaller id that comes later doesn't take a claim


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_run_plan():
    from weftline.plans import run_plan as R
    from weftline.plans.contracts import PLANS, plan_document

    text = json.dumps(plan_document())
    p = R.parse(text)
    assert p.target("test") == 30 and p.binding()["run_plan_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    for _, change, problem in PLANS:
        if problem is None or problem.startswith("quota"):
            R.parse(json.dumps(plan_document(**change)))
            continue
        with pytest.raises(R.PlanError, match=problem):
            R.parse(json.dumps(plan_document(**change)))
    with pytest.raises(R.PlanError, match="quota"):
        R.parse(text, families={"train": 4, "test": 31})
    with pytest.raises(R.PlanError, match="changed"):
        R.parse(text, sources={"family_partition_sha256": "d" * 64})


def test_drafts(spark):
    from weftline.operators import drafts

    e = spark.createDataFrame([(1, [("x", "a"), ("y", "b"), ("z", "c")])], "seed long, entries array<struct<id:string,text:string>>")
    got = e.select(drafts.reidentified(F.col("entries"), F.col("seed")).alias("e")).first().e
    assert [x.id for x in got] == ["c0", "c1", "c2"] and sorted(x.text for x in got) == ["a", "b", "c"]
    context = ("unknown", "label", "", True, "code_editor", False, "", '{"format":"focus-text-v1","selectionKnown":true,"beforeSelection":"x = ","afterSelection":"","nearbyText":[]}')
    schema = "context struct<applicationCategory:string,fieldLabel:string,fieldRole:string,hasAccessibility:boolean,inputSurface:string,isSecure:boolean,selectedText:string,surroundingText:string>, entries array<struct<id:string,text:string>>, label struct<abstain_reason:string,acceptable_ids:array<string>,decision:string>, family string"
    rows = [(context, [("a", "1"), ("b", "(")], (None, [i], "select"), f) for i, f in (("a", "python_x"), ("b", "python_x"), ("b", "other"))]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(drafts.program_problem(F.col("context"), F.col("entries"), F.col("label"), F.col("family"))).collect()] == [None, "python_syntax", None]
    assert [r[0] for r in df.select(gates.placement_problem(F.col("context"), F.col("entries"), F.col("label"), F.col("family"))).collect()] == [None, "python_syntax", None]
    numbers = spark.range(10)
    assert drafts.first_by_predicate(numbers, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 3)], [F.col("id")]) == [("even", 0), ("small", 1)]


def test_published_snapshot_holds_all_rows(spark, monkeypatch):
    from weftline.plans import pipelines

    done, publish = [], pipelines.records.publish
    monkeypatch.setattr(pipelines, "table", lambda *_: spark.createDataFrame([(i, f"t{i}", "en") for i in range(1, 10)], "doc_id long, text string, lang string"))
    monkeypatch.setattr(pipelines.records, "publish", lambda *a, **k: done.append(publish(*a, **k)))
    assert {r.doc_id for r in pipelines.published_snapshot(spark, "").collect()} == set(range(1, 10))
    assert done[0]["rows"] == 9
