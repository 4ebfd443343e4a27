import pytest
import json

from pyspark.sql import functions as F

from dealweave.functions import model_output as J
from dealweave.operators import clauses as CL
from dealweave.operators import documents as DO
from dealweave.operators import policy as PO
from dealweave.sources import files
from dealweave.streaming import telemetry as ST


def test_mail_csv_semicolon_and_quotes(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿Subject;From: (Name);From: (Address);Message Body;Date\r\nHi;Ann;<Ann@X.com>;\"see Deal Memo.docx\nline \"\"two\"\"; end\";3/4/2026 9:05 AM\r\n".encode())
    assert files.sniff(spark, str(p)) == (";", "UTF-8")
    r = files.read_mail_csv(spark, str(p)).first()
    assert r.sender == "Ann; <Ann@X.com>" and r.from_domain == "x.com" and r.date_received == "2026-03-04T09:05:00"
    assert r.attachments == "see Deal Memo.docx" and r.has_attachments and 'line "two"; end' in r.body


def test_mail_csv_latin1(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("subject,from\ncaf\xe9,a@b.c\n".encode("latin-1"))
    assert files.read_mail_csv_first(spark, str(p)).first().subject == "café"


def test_mail_json_both_forms(spark, tmp_path):
    for name, body in (("a.json", {"emails": [{"subject": "s", "sender": "me", "attachments": ["x.pdf", "y.pdf"]}]}), ("b.json", [{"subject": "s", "from": "me", "attachments": ["x.pdf", "y.pdf"]}])):
        (tmp_path / name).write_text(json.dumps(body))
        r = files.read_mail(spark, str(tmp_path / name)).first()
        assert (r.subject, r.sender, r.attachments) == ("s", "me", "x.pdf; y.pdf")


def test_calendar_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Subject,Start Date,End Date,Duration\nA,3/4/2026 9:00 AM,3/4/2026 9:50 AM,\nB,3/4/2026 9:00 AM,,30\nC,,,10\n")
    assert {(r.summary, r.duration_minutes) for r in files.read_calendar_csv(spark, str(tmp_path / "c.csv")).collect()} == {("A", 50), ("B", 30)}
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Long\r\n  title\r\nDTSTART;TZID=X:20260304T090000\r\nDTEND:20260304T093000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    rows = files.read_ics(spark, str(tmp_path / "c.ics")).collect()
    assert [(r.summary, r.duration_minutes) for r in rows] == [("Long title", 30)]


def test_role_table_fallbacks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Paper,People\nLoan,\"A; B\"\n")
    r = files.read_role_csv(spark, str(tmp_path / "r.csv")).first()
    assert (r.document_name, r.signatories) == ("Loan", "A; B")
    (tmp_path / "bad.csv").write_text("Paper,X\nLoan,one\n")
    try:
        files.read_role_csv(spark, str(tmp_path / "bad.csv"))
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_document_listing(spark, tmp_path):
    for name in ("a.PDF", "sub/b.docx", "sub/c.txt", "packets_output/d.pdf"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    assert {r.name for r in files.list_documents(spark, str(tmp_path)).collect()} == {"a.PDF", "sub/b.docx"}


def test_sinks(spark, tmp_path):
    ix = spark.createDataFrame([("JANE", 1, 2), ("BOB", 1, 1), ("JANE", 1, 1)], "signer_name string, doc_id long, page_num int")
    files.write_index(ix, str(tmp_path / "ix"))
    files.write_packets(ix, str(tmp_path / "pk"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 3
    assert spark.read.parquet(str(tmp_path / "pk/signer_name=JANE")).count() == 2
    files.write_packets(ix, str(tmp_path / "bk"), buckets=2)
    packed = spark.read.parquet(str(tmp_path / "bk"))
    assert packed.count() == 3 and packed.groupBy("signer_name").agg(F.countDistinct("packet_bucket").alias("n")).where("n > 1").isEmpty()
    rep = spark.createDataFrame([("matched_schedules", 1, 2)], "section string, deal_id long, doc_id long")
    files.write_report(rep, str(tmp_path / "rp"))
    assert spark.read.json(str(tmp_path / "rp")).first().section == "matched_schedules"
    files.write_history(ix, str(tmp_path / "hs"))
    assert spark.read.csv(str(tmp_path / "hs"), header=True).count() == 3


def events(tmp_path, n=1000):
    src = tmp_path / "in"
    src.mkdir()
    with open(src / "e.json", "w") as f:
        for i in range(n):
            f.write(json.dumps({"collection": " Prompt_Logs" if i % 2 else "weird", "event_type": "", "payload": '{"k": 1}' if i % 3 else "[1]", "timestamp": "t"}) + "\n")
    return str(src)


def test_ingest_routes_and_resumes(spark, tmp_path):
    raw = ST.read_events(spark, events(tmp_path))
    for _ in range(2):  # a second run over the same checkpoint adds nothing
        ST.ingest(raw, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["collection"]: r["count"] for r in out.groupBy("collection").count().collect()} == {"prompt_logs": 500, "usage_history": 500}
    assert out.where("payload = '{}'").count() == 334 and out.select("event_type").distinct().first()[0] == "event"


def sink(folder, broken):
    """Keeps every chunk as a file, but fails in chunk 2 of ``prompt_logs`` as long as the file ``broken`` exists."""
    def send(collection, chunk, rows):
        import json
        import os

        if collection == "prompt_logs" and chunk == 2 and os.path.exists(broken):
            raise ConnectionError("refused")
        with open(f"{folder}/{collection}-{chunk}.json", "a") as out:
            out.write(json.dumps([r["n"] for r in rows]) + "\n")

    return send


def sent(folder):
    import json

    return {p.stem: [json.loads(line) for line in p.read_text().splitlines()] for p in folder.iterdir()}


@pytest.mark.parametrize("wave", [1, 3])
def test_queue_stops_at_the_failed_chunk_and_goes_on_there(spark, tmp_path, wave):
    queue = spark.createDataFrame([(i * 7, "prompt_logs" if i % 4 else "usage_history", i) for i in range(80)], "n long, collection string, v long").repartition(5)
    folder, broken = tmp_path / "sink", tmp_path / "broken"
    folder.mkdir()
    broken.touch()
    send = sink(str(folder), str(broken))
    with pytest.raises(ST.ChunkFailed) as failed:
        ST.flush_chunks(queue, "n", send, str(tmp_path / "ledger"), chunk=10, wave=wave)
    assert (failed.value.collection, failed.value.chunk) == ("prompt_logs", 2) and failed.value.written == 40
    assert ("prompt_logs-3" in sent(folder)) == (wave > 3) and "prompt_logs-2" not in sent(folder)
    broken.unlink()
    assert ST.flush_chunks(queue, "n", send, str(tmp_path / "ledger"), chunk=10, wave=wave) == 80
    assert ST.flush_chunks(queue, "n", send, str(tmp_path / "ledger"), chunk=10, wave=wave) == 80  # nothing is left to send
    got = sent(folder)
    assert all(len(times) == 1 for times in got.values())
    for c, want in (("prompt_logs", [i * 7 for i in range(80) if i % 4]), ("usage_history", [i * 7 for i in range(80) if not i % 4])):
        assert sum((got[f"{c}-{k}"][0] for k in range(-(-len(want) // 10))), []) == want


def test_stream_of_events_is_flushed_after_a_failure(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, broken = tmp_path / "sink", tmp_path / "broken"
    folder.mkdir()
    broken.touch()
    spark.range(1500).selectExpr("id AS n", "'prompt_logs' AS collection", "'x' AS event_type", "'{}' AS payload").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    raw = ST.read_events(spark, str(tmp_path / "in"), "n long, collection string, event_type string, payload string")
    run = lambda: ST.flush(raw, "n", sink(str(folder), str(broken)), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(Exception, match="chunk 2 of prompt_logs"):
        run()
    assert sorted(sent(folder)) == ["prompt_logs-0", "prompt_logs-1"]
    broken.unlink()
    run()
    assert sorted(sum((v[0] for v in sent(folder).values()), [])) == list(range(1500)) and all(len(v) == 1 for v in sent(folder).values())


def test_stream_usage_equals_batch(spark, tmp_path):
    from dealweave.fixtures import table

    u = table(spark, "/root/testdata/sf0.001", "v_usage").drop("props")
    u.write.parquet(str(tmp_path / "u"))
    live = ST.daily_usage(spark.readStream.schema(u.schema).parquet(str(tmp_path / "u")))
    qy = live.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    qy.awaitTermination()
    want = sorted(map(str, ST.daily_usage(u).collect()))
    assert sorted(map(str, spark.table("daily").select("day", "feature", "uses", "inputs", "outputs", "avg_ms", "max_ms").collect())) == want


def test_model_output(spark):
    texts = ['{"a": 1}', 'x\n{"a": "}{"} tail {', "```json\n{\"b\": 2}\n```", "none", '```\nnot json {"c": 3} x\n```']
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(J.json_text(F.col("t")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": "}{"}', '{"b": 2}', None, '{"c": 3}']
    old = spark.createDataFrame([(1, 1, '{"Side Letter": {"status": "executed", "confidence": 7}}')], "deal int, seq int, payload string")
    r = J.decisions(old, ["deal"]).first()
    assert (r.document_name, r.status, r.confidence, r.has_activity) == ("Side Letter", "Executed", 1.0, True)


def test_policy_entry_forms(spark):
    ids = spark.createDataFrame([(1, "a@x.example.com", "bob", "U1"), (2, "b@y.org", "eve", "")], "ident_id long, email string, username string, user_id string")
    p = PO.identity_parts(ids)
    for entry, want in (("*@x.example.com", {1}), ("@y.org", {2}), (".com", {1}), ("*.example.com", {1}), ("*", {1, 2}), ("all", {1, 2}), ("A@X.example.com ", {1}), ("x.example.com", set()), ("a", {1})):
        rules = spark.createDataFrame([("allowed_emails", entry)], "list_name string, entry string")
        assert {r.ident_id for r in PO.list_hits(p, rules).collect()} == want, entry


def test_clauses_follow_their_notes(spark):
    notes = [("[STRIKE]", ""), ("[Levy on [ADVISOR_NAME] applies]", "Only include if advisor is a US taxpayer."), ("[Fees in [$/EUROS/GBP]]", "")]
    clauses = spark.createDataFrame([(1, n, text, note) for n, (text, note) in enumerate(notes, 1)], "template_id int, clause_id int, clause_text string, footnote_text string")
    people = {1: {"advisor_name": "Ida", "is_us_taxpayer": "yes", "currency": "EUR"}, 2: {"advisor_name": "Ida", "is_us_taxpayer": "no"}, 3: {"is_us_taxpayer": "yes", "currency": "USD"}}
    got = {(r.record_id, r.clause_id): (r.outcome, r.text, r.missing) for r in CL.assemble(
        spark.createDataFrame([(i, 1, d) for i, d in people.items()], "record_id int, template_id int, data map<string,string>"), clauses).collect()}
    assert {got[i, 1][0] for i in people} == {"deleted"}  # a clause of one placeholder-like word
    assert got[1, 2] == ("filled", "Levy on Ida applies", "") and got[2, 2][0] == "deleted" and got[3, 2] == ("preserved", notes[1][0], "ADVISOR_NAME")
    assert [got[i, 3][1:] for i in people] == [("Fees in EUROS", ""), (notes[2][0], "$/EUROS/GBP"), ("Fees in $", "")]


def test_edits_are_counted(spark):
    d = spark.createDataFrame([("Rent of 40 a week; 40 a week in arrears for Birch.",)], "text string")
    r = DO.apply_edits(d, [("40 a week", "45 a week"), ("Birch", "Quillon"), ("absent", "x")]).first()
    assert (r.counts, r.edited) == ([2, 1, 0], "Rent of 45 a week; 45 a week in arrears for Quillon.")


def test_own_policy_fields_are_merged_before_aliases(spark):
    ids = spark.createDataFrame([(1, "a@x.com", "ann", "u1"), (2, "b@x.com", "ben", "u2"), (3, "c@x.com", "cy", "u3"), (4, "d@other.org", "ann", "u4")], "ident_id long, email string, username string, user_id string")
    docs = spark.createDataFrame([
        ("global", "", "blocked_domains", "x.com"), ("username", "ann", "banned_domains", "other.org"), ("userid", "u2", "blocked_domains", ""),
        ("global", "", "reason", "closed"), ("username", "cy", "message", "")], "scope string, scope_key string, field string, value string")
    got = {r.ident_id: r for r in PO.access_decisions(ids, docs).collect()}
    assert not got[1].allowed  # the global list comes first among the aliases
    assert got[2].allowed and got[4].allowed  # an empty own list clears the global one
    assert not got[3].allowed and got[3].message == "closed"


def test_rows_of_one_split_are_spread_before_the_work(spark):
    ids = spark.createDataFrame([(1, "a@b.c", "u", "x"), (1, "a@b.c", "u", "x")], "ident_id long, email string, username string, user_id string").coalesce(1)
    rules = spark.createDataFrame([("blocked_users", "u"), ("allowed_emails", "*")], "list_name string, entry string")
    hits = PO.list_hits(PO.identity_parts(ids), rules)
    assert "RepartitionByExpression" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.list_name for r in hits.collect()) == ["allowed_emails", "blocked_users"]


def test_clause_work_is_done_once_and_records_are_spread(spark):
    clauses = spark.createDataFrame([(1, 1, "[x]", ""), (1, 2, "[Pay [DAILY_RATE] in [$/EUR]]", "Remove if in EU")], "template_id int, clause_id int, clause_text string, footnote_text string")
    rec = spark.createDataFrame([(7, 1, {"rate": "9", "currency": "eur", "geography": "LATAM", "own": None})], "record_id int, template_id int, data map<string,string>").coalesce(1)
    out = CL.assemble(rec, clauses)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert plan.count("payment_currency") <= 2 and plan.count("daily_fee") <= 2  # a record's map is made in one place, not in every use of it
    assert [(r.outcome, r.text) for r in out.orderBy("clause_id").collect()] == [("deleted", ""), ("filled", "Pay 9 in EUR")]


def test_every_wave_reads_only_its_own_part_of_the_queue(spark, tmp_path, monkeypatch):
    read = []
    plain = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: read.append(plain(self, path).count()) or plain(self, path))
    monkeypatch.setattr(ST, "SHELF", 2, raising=False)
    queue = spark.createDataFrame([(i, "prompt_logs") for i in range(100)], "n long, collection string")
    assert ST.flush_chunks(queue, "n", lambda c, k, rows: None, str(tmp_path / "ledger"), chunk=10, wave=2) == 100
    assert read == [20] * 5
    assert sorted((r.chunk, r.rows) for r in ST.ledger(spark, str(tmp_path / "ledger")).collect()) == [(k, 10) for k in range(10)]
