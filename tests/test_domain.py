"""Golden cases of the record pipeline on small fixtures."""

from __future__ import annotations

import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from docketflow.functions import dates as D
from docketflow.functions import jsonvalue as J
from docketflow.functions import text as X
from docketflow.operators import audit, collection, definitions, export, movements, reconcile, signals, watch
from docketflow.operators.filters import CaseTables, DiscoveryQuery, ProcessFilters, select_processes
from docketflow.operators.analytics import overview_statistics, signal_distribution, theme_distribution
from docketflow.plans import ingest
from docketflow.sources import pages, reference, reports, tables
from docketflow.streaming import page_stream

DAY = dt.datetime(2026, 10, 1, 12)


def movement(code=100, name="Conclusão", when="2026-10-04T14:00:00Z", **extra):
    return {"codigo": code, "nome": name, "dataHora": when, "complementosTabelados": [{"b": 2}, {"a": 1}], **extra}


def source(ident="origin-a", number="00000010020268090001", **fields):
    return {"id": ident, "numeroProcesso": number, "tribunal": "TJGO", **fields}


def hit_rows(spark, sources, start=DAY):
    rows = []
    for n, item in enumerate(sources):
        hit = item if "_source" in item else {"_id": item.get("id"), "_source": item, "sort": [n, "x"]}
        rows.append(("c1", n, f"p{n}", 1, start + dt.timedelta(days=n), "TJGO", "demo", json.dumps(hit, ensure_ascii=False)))
    return spark.createDataFrame(
        rows, "collection_id string, page_revision long, page_key string, hit_ordinal int, responded_at timestamp, tribunal string, mode string, hit string"
    )


def canonical(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", J.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]


def test_canonical_json(spark):
    different = ["{}", '{"campo":null}', "1", '"1"', "1.0", "true", "[1,2]", "[2,1]"]
    assert len(set(canonical(spark, different))) == len(different)
    same = ['{"a":1,"b":[1,{"d":1,"c":2}]}', ' { "b" : [1, {"c":2,"d":1}], "a":1 }']
    assert len(set(canonical(spark, same))) == 1
    odd = ['{"x":1e3,"é":"\\u001f😀"}', '{"b":1,"b":2}', '{"n":123456789012345678901234567890123456789012}']
    assert canonical(spark, odd) == [json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"), sort_keys=True) for t in odd]
    assert canonical(spark, ["NaN", "nope"]) == [None, None]


def test_cover_checks(spark):
    good = source()
    bad = [
        ({"_id": "a", "_source": 5, "sort": [1]}, "COVER_NOT_OBJECT"),
        (source(ident=" "), "SOURCE_ID_INVALID"),
        ({"_id": 7, "_source": good, "sort": [1]}, "HIT_SOURCE_ID_INVALID"),
        ({"_id": "other", "_source": good, "sort": [1]}, "SOURCE_ID_MISMATCH"),
        (source(number="123"), "CNJ_INVALID"),
        (source(number=123), "CNJ_INVALID"),
        (dict(good, tribunal="TJSP"), "TRIBUNAL_INVALID"),
        (good, None),
    ]
    prepared = ingest.prepare_hits(hit_rows(spark, [item for item, _ in bad]))
    got = [r.validation_code for r in prepared.orderBy("page_revision").collect()]
    assert got == [code for _, code in bad]


def test_cover_fields(spark):
    full = source(
        classe={"codigo": 1116, "nome": " Execução "}, orgaoJulgador={"codigo": " 12 ", "nome": ""}, grau="G1",
        assuntos=[{"codigo": None}, {"codigo": 4968, "nome": "A"}, "x", [{"codigo": 1}], {"nome": "B"}],
        dataAjuizamento="20260110120000", **{"@timestamp": "2026-01-11T12:00:00-03:00"},
    )
    odd = source("origin-b", classe={"codigo": True}, orgaoJulgador={"codigo": 1.5}, dataAjuizamento=20260110)
    valid = ingest.valid_hits(ingest.prepare_hits(hit_rows(spark, [full, odd])))
    a, b = valid.orderBy("page_revision").collect()
    assert (a.class_code, a.class_name, a.court_unit_code, a.court_unit_name) == ("1116", "Execução", "12", None)
    assert a.filed_at is None and a.filed_ambiguous and a.updated_at == dt.datetime(2026, 1, 11, 15)
    assert (b.class_code, b.court_unit_code, b.filed_original) == (None, None, "20260110")
    listed = ingest.subjects(ingest.versions(valid)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.subject_code, r.subject_name) for r in listed] == [(1, "4968", "A"), (2, None, "B")]


def test_outcomes_and_regression(spark):
    a, b = source(grau="G1", dataAjuizamento="20260110120000"), source(grau="G2", dataAjuizamento="20250110120000")
    observed = ingest.observations(ingest.valid_hits(ingest.prepare_hits(hit_rows(spark, [a, a, b, a]))))
    rows = observed.orderBy("page_revision").collect()
    assert [r.capture_outcome for r in rows] == ["new", "unchanged", "updated", "updated"]
    assert [r.filed_regressed for r in rows] == [False, False, True, False]


def pipeline(spark, sources):
    valid = ingest.valid_hits(ingest.prepare_hits(hit_rows(spark, sources)))
    stored = ingest.versions(valid)
    elements = movements.explode_movements(stored)
    return valid, stored, elements, movements.movement_issues(stored, elements)


def test_array_completeness(spark):
    cases = [source("a"), source("b", movimentos=None), source("c", movimentos="x"), source("d", movimentos=[]),
             source("e", movimentos=[movement(), 7, '{"codigo":1}'])]
    _, stored, _, issues = pipeline(spark, cases)
    names = {r.version_id: r.source_id for r in stored.select("version_id", "source_id").collect()}
    got = sorted((names[r.version_id], r.error_path, r.validation_code) for r in issues.collect())
    assert got == [
        ("a", "movimentos", "MOVEMENTS_FIELD_MISSING"), ("b", "movimentos", "MOVEMENTS_NULL"), ("c", "movimentos", "MOVEMENTS_NOT_ARRAY"),
        ("e", "movimentos[1]", "MOVEMENT_NOT_OBJECT"), ("e", "movimentos[2]", "MOVEMENT_NOT_OBJECT"),
    ]
    complete = {names[r.version_id]: r.is_complete for r in movements.snapshots(stored, issues).collect()}
    assert complete == {"a": False, "b": False, "c": False, "d": True, "e": False}


def test_exact_and_native_movements_agree(spark):
    """A fraction sends the whole payload through the exact form; contents must not change by that."""
    plain = source("a", movimentos=[movement(), movement(when="2026-10-04T14:00:00", code="12"), {"nome": "x", "dataHora": None}])
    fraction = dict(plain, id="b", valor=1.0)
    _, stored, elements, _ = pipeline(spark, [plain, fraction])
    normalized = movements.normalize(elements).join(stored.select("version_id", "source_id"), "version_id")
    rows = normalized.select("source_id", "position", "content", "auxiliary_key", "date_status", "code").collect()
    by = {s: sorted(tuple(r)[1:] for r in rows if r.source_id == s) for s in "ab"}
    assert by["a"] == by["b"] and len(by["a"]) == 3
    keyless = [r for r in rows if r.position == 2 and r.source_id == "a"]
    assert keyless[0].auxiliary_key is None and keyless[0].date_status == "null"
    floats = source("c", movimentos=[movement(campo=1), movement(campo=1.0)])
    _, _, elements, _ = pipeline(spark, [floats])
    assert movements.normalize(elements).select("content_sha256").distinct().count() == 2


def test_permutation_changes_nothing(spark):
    items = [movement(code=c, extra=e) for c in range(3) for e in range(2)] + [movement(code=0, extra=0)]
    shuffled = [dict(reversed(list(m.items())), complementosTabelados=m["complementosTabelados"][::-1]) for m in items]
    random.Random(3).shuffle(shuffled)
    _, _, elements, _ = pipeline(spark, [source(movimentos=items), source(movimentos=shuffled)])
    contents = movements.snapshot_contents(movements.normalize(elements))
    present = movements.present_associations(contents, movements.occurrences(contents))
    assert {r.status for r in present.where("seen.at > '2026-10-01 12:00:00'").collect()} == {"KNOWN"}


def test_multiplicity_series(spark):
    one, two = [movement()], [movement(), movement()]
    _, stored, elements, issues = pipeline(spark, [source(movimentos=one, v=0), source(movimentos=two, v=1), source(movimentos=one, v=2), source(movimentos=two, v=3)])
    contents = movements.snapshot_contents(movements.normalize(elements))
    occurrences = movements.occurrences(contents)
    assert [(r.first_ordinal, r.last_ordinal) for r in occurrences.orderBy("first_ordinal").collect()] == [(1, 1), (2, 2)]
    present = movements.present_associations(contents, occurrences)
    got = [[(r.first_ordinal, r.status) for r in present.where(F.col("seen.at") == DAY + dt.timedelta(days=n)).orderBy("first_ordinal").collect()] for n in range(4)]
    assert got == [[(1, "FIRST_OBSERVED")], [(1, "KNOWN"), (2, "FIRST_OBSERVED")], [(1, "KNOWN")], [(1, "KNOWN"), (2, "KNOWN")]]
    third = movements.snapshots(stored, issues).where(F.col("processed_at") == DAY + dt.timedelta(days=2))
    absent = movements.absent_associations(third, contents, occurrences).collect()
    assert [(r.first_ordinal, r.last_ordinal) for r in absent] == [(2, 2)]


@pytest.mark.parametrize("change,status", [({"nome": "Outro"}, "ALTERATION_OBSERVED"), ({"campoExtra": 1}, "ALTERATION_OBSERVED"),
                                           ({"complementosTabelados": [{"c": 3}]}, "FIRST_OBSERVED")])
def test_alteration(spark, change, status):
    after = dict(movement(), **change)
    _, _, elements, _ = pipeline(spark, [source(movimentos=[movement()]), source(movimentos=[after])])
    contents = movements.snapshot_contents(movements.normalize(elements))
    occurrences = movements.occurrences(contents)
    present = movements.present_associations(contents, occurrences)
    last = present.where("seen.at > '2026-10-01 12:00:00'").collect()
    assert [r.status for r in last] == [status]
    counts = movements.alteration_counts(contents, occurrences, present).collect()
    assert [(r.previous_count, r.current_count, r.ambiguous) for r in counts] == ([(1, 1, False)] if status == "ALTERATION_OBSERVED" else [])


def test_reconcile_keeps_history(spark):
    current = spark.createDataFrame([("r", "a", 1), ("r", "b", 3)], "o string, h string, copies long")
    history = spark.createDataFrame([("r", "a", 2), ("r", "c", 1), ("s", "a", 1)], "o string, h string, copies long")
    got = sorted(tuple(r) for r in reconcile.reconcile(current, history, "o", "h").select("h", "status", "first_ordinal", "last_ordinal").collect())
    assert got == [("a", "KNOWN", 1, 1), ("a", "NOT_PRESENT_IN_SNAPSHOT", 2, 2), ("b", "FIRST_OBSERVED", 1, 3), ("c", "NOT_PRESENT_IN_SNAPSHOT", 1, 1)]
    after = reconcile.updated_history(current, history, ["o", "h"])
    again = reconcile.reconcile(after, after, "o", "h")
    assert {r.status for r in again.collect()} == {"KNOWN"}
    assert reconcile.expand_ranges(again.select("o", "h", "first_ordinal", "last_ordinal"), chunk=2).count() == 2 + 3 + 1 + 1


def test_unknown_normalizer():
    with pytest.raises(LookupError):
        movements.normalizer("movement-normalizer-v9")


def overview_seed(spark):
    frame = spark.createDataFrame
    at = lambda d: dt.datetime(2026, 10, d, 12)
    return CaseTables(
        processes=frame([("p1", "00000010020268090001"), ("p2", "00000020020268090001")], "process_id string, process_number string"),
        representations=frame([("r1", "p1", "TJGO", at(1)), ("r2", "p1", "TJGO", at(2)), ("r3", "p2", "TJMG", at(3))],
                              "representation_id string, process_id string, tribunal string, last_observed_at timestamp"),
        subjects=frame([("r1", "4968", "S"), ("r1", "4969", "T"), ("r2", "4968", "S"), ("r3", "4968", "S")],
                       "representation_id string, subject_code string, subject_name string"),
        triage=frame([("p2", "discarded", "unconfirmed")], "process_id string, decision string, rural_link string"),
        watchlist=frame([("p1", True)], "process_id string, active boolean"),
        news=frame([("p1", "pending"), ("p1", "pending")], "process_id string, status string"),
        signals=frame([("p1", "sinal.penhora", "1.0.0", "penhora"), ("p1", "sinal.penhora", "1.0.0", "penhora"), ("p1", "sinal.penhora", "0.9.0", "penhora"),
                       ("p2", "sinal.leilao", "1.0.0", "leilao")], "process_id string, rule_id string, rule_version string, category string")
        .withColumns({"environment": F.lit("demo"), "is_published": F.lit(True), "is_current": F.lit(True)}),
        rules=reference.rules_frame(spark),
    )


def test_overview(spark):
    seed = overview_seed(spark)
    row = overview_statistics(seed, ProcessFilters()).first()
    assert tuple(row)[:7] == (2, 3, 1, 0, 1, 1, 2) and row.latest_observation_at == dt.datetime(2026, 10, 3, 12)
    assert {tuple(r) for r in signal_distribution(seed, ProcessFilters()).collect()} == {("leilao", 1), ("penhora", 1)}
    assert [(r.subject_code, r.process_count) for r in theme_distribution(seed, ProcessFilters()).collect()] == [("4968", 2), ("4969", 1)]
    cut = overview_statistics(seed, ProcessFilters(subject_code="4968", decision="pending")).first()
    assert (cut.process_count, cut.representation_count, cut.pending_news_count) == (1, 2, 2)
    none = overview_statistics(seed, ProcessFilters(subject_code="1")).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, 0, None)


def test_filter_arguments(spark):
    for bad in ({"tribunals": ()}, {"tribunals": ("TJGO", "tjgo")}, {"tribunals": ("XX",)}, {"process_number": "1"}):
        with pytest.raises(ValueError):
            ProcessFilters(**bad).resolved()
    assert ProcessFilters(subject="  ").resolved().subject == "" or ProcessFilters(subject="  ").resolved().subject is None
    for bad in ({}, {"filed_from": "2026-01-01"}, {"filed_from": "2026-01-02", "filed_to": "2026-01-02"}, {"class_codes": (0,)}):
        with pytest.raises(ValueError):
            DiscoveryQuery("TJGO", **bad).checked()
    assert select_processes(overview_seed(spark), ProcessFilters(followed=False)).count() == 1


def test_csv(spark, tmp_path):
    cells = {name: "" for name in export.HEADERS} | {"numero_cnj": "1", "classes": 'a;"b"', "assuntos": "'=x"}
    rows = spark.createDataFrame([tuple(cells[n] for n in export.HEADERS) + ("p1",)], [*export.HEADERS, "process_id"])
    with pytest.raises(export.ExportTooLarge):
        export.write_csv(rows, str(tmp_path / "none"), 0)
    assert export.write_csv(rows, str(tmp_path / "csv"), 1) == 1
    body = b"".join(open(p, "rb").read() for p in glob.glob(str(tmp_path / "csv" / "part-*")))
    assert body.startswith(b"\xef\xbb\xbfnumero_cnj;tribunal;")
    assert body.endswith(b'1;;"a;""b""";;;\'=x;;;;;;;;\r\n') and body.count(b"\r\n") == 2


def test_formula_neutralizer(spark):
    texts = ["=1+1", "+SUM(1;1)", "-1+1", "@SUM(1)", "\t=1+1", "\r=1+1", "  @SUM(1)", " =1", "ok", "a=1", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", X.neutralized(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == ["'" + t for t in texts[:8]] + texts[8:]


def test_calendar(spark):
    cases = [("2026-10-09T08:59:00Z", "2026-10-09 09:00"), ("2026-10-09T09:00:00Z", "2026-10-10 09:00"), ("2026-12-31T10:00:00Z", "2027-01-01 09:00")]
    df = spark.createDataFrame(cases, "t string, e string")
    got = df.select(F.date_format(D.next_daily_run(F.to_timestamp("t")), "yyyy-MM-dd HH:mm").alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)
    leap = spark.range(1).select(D.months_before(F.lit("2024-02-29").cast("date"), 12).cast("string").alias("d")).first().d
    assert leap == "2023-02-28"


def test_signals(spark):
    first = source(movimentos=[movement(code=11382)])
    broken = source(v=2)
    rules = reference.rules_frame(spark)
    for sources, stale, status in (([first], False, "completed"), ([first, broken], True, "stale")):
        valid, stored, elements, issues = pipeline(spark, sources)
        current = ingest.representations(ingest.observations(valid), stored).withColumnRenamed("process_number", "process_id")
        manifest = signals.input_manifest(current, movements.snapshots(stored, issues))
        contents = movements.snapshot_contents(movements.normalize(elements))
        moves = contents.select("version_id", "code", F.col("content_sha256").alias("occurrence_id"))
        evaluations = signals.evaluate(manifest, moves, rules)
        assert evaluations.where("outcome = 'matched'").count() == 1 and evaluations.first().evidence_stale is stale
        statuses = signals.process_status(evaluations, current)
        assert statuses.first().run_status == status
        wanted = signals.desired_signals(manifest, evaluations, moves, rules)
        empty = wanted.select("process_id", "representation_id", "rule_id", "rule_version", "category", "signal_id").limit(0).withColumns(
            {"environment": F.lit("demo"), "is_published": F.lit(True), "is_current": F.lit(True), "evidence_stale": F.lit(False)})
        once = signals.publish(empty, wanted, statuses, rules, "demo")
        twice = signals.publish(once, wanted, statuses, rules, "demo")
        assert once.collect() == twice.collect() and once.first().evidence_stale is stale and once.count() == 1


def test_one_bad_code_blocks_its_input(spark):
    rules = reference.rules_frame(spark)
    manifest = spark.createDataFrame([("p", "r", "v", "v", True, False)], "process_id string, representation_id string, latest_version_id string, input_version_id string, input_complete boolean, evidence_stale boolean")
    moves = spark.createDataFrame([("v", "311", "o1"), ("v", None, "o2")], "version_id string, code string, occurrence_id string")
    assert {r.outcome for r in signals.evaluate(manifest, moves, rules).collect()} == {"not_evaluated"}


def test_rule_selection_errors(spark):
    rules = reference.rules_frame(spark)
    assert signals is not None and reference.select_rules(rules, "demo").count() == 3
    with pytest.raises(PermissionError):
        reference.select_rules(rules, "real", ["sinal.penhora"])
    with pytest.raises(LookupError):
        reference.select_rules(rules, "demo", ["nada"])


def test_catalog(spark, tmp_path):
    status = {"state": "validated", "reason": "ok"}
    code = {"dimension": "subject", "code": 1, "name": "Um", "situation": "A", "tjgo_first_grade": True, "tjgo_second_grade": False, "selectable_for_custom": True}
    item = {"kind": "preset", "id": "i", "version": "1", "family": "f", "name": "I", "filters": {"classes": [], "subjects": [1], "movements": []},
            "combinations": {"between_dimensions": "AND"}, "tpu_status": status, "query_status": status, "sample_status": status,
            "required_for_real": ["tpu_status"], "demo_available": True, "runtime_implemented": True}
    family = {"id": "f", "name": "F", "investigation_state": "investigated", "item_ids": ["i"], "pending_reason": None}
    document = {"schema_version": 1, "catalog_version": "1", "tpu_version": "1", "families": [family], "tpu_code_evidence": [code], "items": [item]}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(document))
    catalog = reference.read_theme_catalog(spark, str(path))
    assert [tuple(r) for r in catalog.item_codes.collect()] == [("i", "subject", 1)]
    item["filters"]["subjects"] = [2]
    path.write_text(json.dumps(document))
    spark.catalog.clearCache()
    with pytest.raises(ValueError, match="unknown code"):
        reference.read_theme_catalog(spark, str(path))
    rules = {"schema_version": 1, "rules": [{"id": "a", "version": "1", "category": "c", "name": "n", "predicate": {"scope": "movement", "field": "codigo", "operator": "equals_any", "values": [3]},
             "enablement": {"demo": {"enabled": True}, "real": {"enabled": False}}}]}
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    assert reference.read_rules(spark, str(tmp_path / "rules.json")).count() == 1
    rules["rules"] *= 2
    (tmp_path / "rules2.json").write_text(json.dumps(rules))
    with pytest.raises(ValueError):
        reference.read_rules(spark, str(tmp_path / "rules2.json"))


def test_reports(spark, tmp_path):
    report = {"alias": "tjgo", "run_id": "1", "started_at": "x", "requests_made": 2, "stop_reason": None,
              "s1_s2": {"aggregate_state": "VALIDATED", "capabilities": {"envelope": {"state": "VALIDATED"}}, "requests": [{"name": "q", "outcome": "ERROR", "error_code": "T", "http_status": 500}]},
              "s5_pairs": [{"preset_id": "p", "pair_state": "NOT_RUN", "catalog_version": "1", "preset_version": "1", "applicability": {"state": "APPLICABLE", "tpu_version": "1"}, "requests": []}]}
    (tmp_path / "a.json").write_text(json.dumps(report))
    (tmp_path / "b.json").write_text(json.dumps(report, indent=2))
    read = reports.read_reports(spark, str(tmp_path))
    assert read.select("report_sha256").distinct().count() == 1
    unique = audit.deduplicated_attempts(read, ["run_id", "alias"], "report_sha256").first()
    assert unique.reports == 2 and not unique.divergent
    one = read.dropDuplicates(["run_id", "alias"])
    found = audit.batch_exceptions(one, reports.report_requests(one), reports.pair_attempts(one)).first()
    assert (found.failed_requests, found.pairs_not_run) == ("q", "p")
    assert reports.capability_attempts(one).first().state == "VALIDATED"


def test_decision_conflicts(spark):
    rows = [("p", 1, 0, "relevant", None, None), ("p", 2, 0, "discarded", None, None), ("p", 3, 1, None, "confirmed", " "), ("p", 4, 1, None, "confirmed", " nota "),
            ("p", 5, 2, "relevant", None, None), ("p", 6, 2, "pending", None, None)]
    requests = spark.createDataFrame(rows, "process_id string, n int, expected_version int, decision string, rural_link string, note string")
    got = [tuple(r)[1:5] for r in definitions.fold_requests(requests, ["n"]).orderBy("version").collect()]
    assert got == [(1, "relevant", "unconfirmed", ""), (2, "relevant", "confirmed", "nota"), (3, "pending", "confirmed", "nota")]


def test_watch_noops(spark):
    log = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 3, True), ("p", 4, False), ("p", 5, True)], "process_id string, event_id int, wanted boolean")
    log = log.withColumn("at", F.timestamp_seconds(F.col("event_id") * 100_000))
    cycles = watch.watch_cycles(log).orderBy("cycle_number").collect()
    assert [(c.cycle_number, c.ended_at is None) for c in cycles] == [(1, False), (2, True)]


def test_quarantine_and_budget(spark):
    pages_ = spark.createDataFrame([("c", 0, 3), ("c", 1, 3), ("c", 2, 3)], "collection_id string, page_revision long, hits long")
    assert [r.kept for r in collection.cap_to_budget(pages_, 4).orderBy("page_revision").collect()] == [3, 1, 0]


def page_files(spark, folder, batches):
    rows = []
    for revision, sources in enumerate(batches):
        hits = [{"_id": s["id"], "_source": s, "sort": [revision, s["id"]]} for s in sources]
        rows.append(("c", revision, DAY + dt.timedelta(days=revision), "TJGO", "demo", json.dumps({"hits": {"total": 5, "hits": hits}})))
    frame = spark.createDataFrame(rows, pages.PAGE_SCHEMA)
    frame.repartition(len(rows), "page_revision").write.mode("append").parquet(folder)


def test_stream_replay_and_conflict(spark, tmp_path):
    batches = [[source("a"), source("b")], [source("a", grau="G2"), source("x", number="1")], []]
    page_files(spark, str(tmp_path / "in"), batches)
    store = page_stream.FactStore(str(tmp_path / "facts"))
    for name, size in (("one", 1), ("two", 2)):
        page_stream.start(spark, str(tmp_path / "in"), store, str(tmp_path / name), files_per_batch=size).awaitTermination()
        assert page_stream.observations(spark, store).count() == 3
        assert spark.read.parquet(store.path("versions")).count() == 3
        assert spark.read.parquet(store.path("quarantine")).count() == 1
        assert spark.read.parquet(store.path("pages")).count() == 3
    page_files(spark, str(tmp_path / "changed"), [[source("a", grau="G9"), source("b")]])
    changed = pages.read_page_files(spark, str(tmp_path / "changed"))
    with pytest.raises(page_stream.ReplayConflict):
        page_stream.ingest_batch(changed, "changed", store)
    page_stream.ingest_batch(changed, "changed", store, strict=False)
    assert spark.read.parquet(store.path("conflicts")).count() == 1
    assert page_stream.observations(spark, store).count() == 3


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        tables.append_new(rows, str(tmp_path / "t"), ["k"], ["v"], "b1")
        tables.append_new(rows, str(tmp_path / "t"), ["k"], ["v"], "b2")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()) == [(1, "a"), (2, "c")]
