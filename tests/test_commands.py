"""Command lines, indicators and transcripts: odd values, and cases worked out by hand."""

import json
import uuid

from pyspark.sql import functions as F

from vestige.functions import commands as C, text as T
from vestige.sinks import lines as K
from vestige.sources import lines as L, transcripts as S


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "c string").select(*(f.alias(f"x{i}") for i, f in enumerate(columns))).first())


def test_odd_commands(spark):
    c = F.col("c")
    assert one(spark, None, C.stages(c), C.verbs(c), C.write_targets(c), C.shell_text(c)) == ([], [], [], None)
    assert one(spark, "", C.verbs(c), C.delete_targets(c), C.is_read_only(c), C.is_upload(c), C.is_outbound(c)) == ([], [], False, False, False)
    long = "cat <<EOF\n" + "rm -rf / 'x\n" * 20000 + "EOF\nls '" + "a b\\" * 5000 + "'"
    assert one(spark, long, C.verbs(C.shell_text(c)), C.delete_targets(C.shell_text(c))) == (["cat", "ls"], [])
    assert one(spark, 'echo "' + "a \\\" b " * 3000 + '"', C.shell_text(c)) == ('echo ""',)


def test_commands(spark):
    c = F.col("c")
    assert one(spark, "a && b || c | d; e\nf |", F.transform(C.stages(c), lambda s: F.concat(s["text"], s["piped"].cast("string")))) == (["afalse", "bfalse", "cfalse", "dtrue", "efalse", "ffalse"],)
    assert one(spark, "A=1 /usr/bin/env x; ./run.sh; -v", C.verbs(c)) == (["env", "./run.sh", "-v"],)
    assert one(spark, "bash -c 'rm -rf /srv/a b' && echo 'no rm'", C.shell_text(c)) == ("bash -c 'rm -rf /srv/a b' && echo ''",)
    assert one(spark, "cat <<-'X' > f\nrm a\n\tX\nls", C.without_heredocs(c)) == ("cat <<X > f\nls",)
    assert one(spark, "cat <<X\nnever ends", C.without_heredocs(c)) == ("cat <<X",)
    assert one(spark, "D=/a\nD=/b\ncp x ${D}/y; ls $D", C.expanded(c)) == ("D=/a\nD=/b\ncp x /b/y; ls /b",)
    assert one(spark, "ls > a; echo x>>'b c'; tee -a d | cp -r e f; mv g", C.write_targets(c))[0][0] == "a"
    assert one(spark, "truncate -s 0 a; shred -u b; mkdir c", C.delete_targets(c)) == (["0", "a", "b"],)
    assert one(spark, "curl -O https://a.b/c/d.tgz?x#y; wget -O - https://a.b/e; curl https://a.b/f", C.downloaded_paths(c)) == (["d.tgz"],)
    assert one(spark, "sudo ./a; python3 -m http.server; python3 -u b.py; chmod 755 c; ~/d", C.executed_paths(c)) == (["./a", "b.py", "c", "~/d"],)
    assert one(spark, "curl -o p.pdf https://a.b/p && python3 -c 'count pages'", C.downloads_then_runs(c)) == (False,)
    assert one(spark, "sed -i s/a/b/ f", C.is_read_only(c)) == (False,)
    assert one(spark, "cat .env.example", C.sensitive_place(c)) == (None,)
    assert one(spark, "cat .env", C.sensitive_place(c)) == (".env",)
    assert one(spark, "/Users/a/node_modules/b", C.is_scratch(c)) == (True,)


def test_names(spark):
    c = F.col("c")
    near = {b: one(spark, b, T.within_one_edit(F.lit("mcp-server"), c))[0] for b in ("mcp-server", "mpc-server", "mcp-serve", "mcp-serverx", "ncp-server", "mpc-sevrer", "")}
    assert near == {"mcp-server": True, "mpc-server": True, "mcp-serve": True, "mcp-serverx": True, "ncp-server": True, "mpc-sevrer": False, "": False}
    assert one(spark, "näme", T.uuid5(str(uuid.NAMESPACE_DNS), c)) == (str(uuid.uuid5(uuid.NAMESPACE_DNS, "näme")),)
    for host, under in (("A.Example.org:443", True), ("A.Example.org.:443", True), ("example.org.", True), ("myexample.org", False), ("example.org.uk", False)):
        assert one(spark, host, T.host_under(c, F.lit("example.org"))) == (under,)
    assert one(spark, None, T.host_under(c, F.lit("example.org")), T.holds_domain(c, "example.org"), T.service_category(c), T.refusal(c)) == (None, None, None, None)
    assert one(spark, "<system-reminder> x", T.is_instruction(F.lit("human_prompt"), c), T.is_instruction(F.lit("agent_message"), c)) == (False, True)


def test_transcript_files(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s", "timestamp": "2024-05-01T10:00:00Z", "isSidechain": True, "message": {"role": "user", "content": "[not json"}},
        {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}},
        {"type": "summary", "sessionId": "s"},
    ]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([*map(json.dumps, lines), "", "  ", '{"type": "user"', "noise"]))
    got = S.read(spark, str(path), "session")
    assert sorted(r.event_type for r in got.collect()) == ["agent_message", "session_meta", "tool_result", "trace_gap", "trace_gap"]
    by_kind = {r.event_type: r for r in got.where("event_type <> 'trace_gap'").collect()}
    assert by_kind["agent_message"].text == "[not json" and by_kind["agent_message"].time is not None
    assert by_kind["tool_result"].text == "a\nb" and by_kind["tool_result"].error and by_kind["tool_result"].call_id == "t"
    empty = spark.createDataFrame([], "artifact string, value string")
    for dialect in S.DIALECTS.values():
        assert dialect(empty).count() == 0


def test_chat_shapes(spark):
    rows = [{"role": "model", "parts": [{"text": "x"}, {"functionCall": {"name": "sh", "args": {"command": "ls"}}}]}, {"role": "user", "parts": [{"functionResponse": {"name": "sh", "response": {"o": 1}}}]}, {"who": "human", "said": "hi"}]
    df = spark.createDataFrame([("f", json.dumps(r)) for r in rows[:2]], "artifact string, value string")
    assert {(r.event_type, r.text, r.tool, r.command) for r in S.chat_lines(df).collect()} == {("model_response", "x", None, None), ("tool_call", None, "sh", "ls"), ("tool_result", '{"o":1}', "sh", None)}
    other = spark.createDataFrame([("f", json.dumps(rows[2]))], "artifact string, value string")
    assert [(r.event_type, r.text) for r in S.chat_lines(other, S.Fields(role="$.who", content=("$.said",))).collect()] == [("human_prompt", "hi")]


def test_telemetry_lines(spark):
    values = [None, "", "noise", "{}", '{"ts": 1', '{"ts": 1714557600.5, "method": "GET", "host": "A.org", "uri": "/x", "id.resp_h": "10.0.0.1"}', "May 1 10:00:00 h unbound[1:0] info: 10.0.0.2 b.org. A IN", '{"Type": "container", "Status": "health_status"}', '{"details": {"author_name": "u", "add": "key"}, "created_at": "2024-05-01T10:00:00Z"}']
    got = L.by_line(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, n int"))
    assert sorted((r.n, r.source, r.dest_host, r.cmdline, r.user) for r in got.collect()) == [(5, "zeek-http", "a.org", "GET", None), (6, "unbound", "b.org", "A", None), (8, "gitlab", None, "key", "u")]
    assert L.by_line(spark.createDataFrame([], "value string")).count() == 0


def test_documents_of_findings(spark):
    rows = [("R", "HIGH", "t", "s", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "rule_id string, severity string, title string, session_id string, ref string")
    sarif, notes = [json.loads(r.value) for r in K.sarif_results(df).collect()], [json.loads(r.value) for r in K.stix_notes(df, "report--x").collect()]
    assert sarif[0]["level"] == "error" and "locations" not in sarif[0] and sarif[1]["level"] == "none"
    assert notes[0]["id"] == "note--" + str(uuid.uuid5(uuid.NAMESPACE_URL, "R|s||t")) and notes[0]["object_refs"] == ["report--x"]
    edges = spark.createDataFrame([('a"b', None, "x|y")], "from string, to string, relation string")
    line = K.mermaid(edges).first().value
    assert '["a#quot;b"]' in line and '|"x#124;y"|' in line and line.endswith('[""]')


def test_what_opens_a_here_document(spark):
    """Bodies go where a program only reads them, and stay where one runs them; a << in quotes, arithmetic or behind a figure opens nothing."""
    same = [
        "python -c \"exec(b64decode('eA=='))\"", 'grep x <<< "$v"\nnext', "bash <<'EOF'\necho H4sI | base64 -d | sh\nEOF", "python3 - <<EOF\nimport os\nEOF", 'python3 -c "print(1<<X)"\nrm -rf ./x\nnext', "echo $((1<<N))\nrm ./a\nN", "echo 1<<X\nls", "echo 'a <<EOF'\nrm b\nEOF",
        "sudo bash -s <<EOF\nrm -rf /x\nEOF", "A=1 /usr/bin/python3.11 - \"x y\" <<-'PY'\n\tprint(1)\n\tPY\nls", "echo don't <<EOF\nrm c", "", None,
    ]
    cut = [
        ("cd x && cat > f.md <<'EOF'\nclaude -p x\nDROP DATABASE prod;\nEOF\necho done", "cd x && cat > f.md <<EOF\necho done"),
        ("cat <<A > f\nrm -rf /\nA\nls", "cat <<A > f\nls"), ("cat <<-X\n\tid_rsa\n\tX\nls", "cat <<X\nls"), ("cat <<E\nnever closed\nrm x", "cat <<E"), ("echo 'it is' && tee a <<Q\n\"\nQ\nrm y", "echo 'it is' && tee a <<Q\nrm y"), ("mybash <<EOF\nrm x\nEOF", "mybash <<EOF"),
    ]
    df = spark.createDataFrame([(c, c) for c in same] + cut, "c string, w string")
    got = df.select("c", "w", C.without_heredocs(F.col("c")).alias("g")).collect()
    assert [(r.c, r.g) for r in got] == [(r.c, r.w) for r in got]


def test_nothing_hides_a_delete(spark):
    rows = [
        ('python3 -c "print(1<<X)"\nrm -rf ./x\nnext', ["./x"]), ("bash <<'EOF'\nrm -rf /srv/x\nEOF", ["/srv/x"]), ("python3 - <<'EOF'\nrm -rf /srv/x\nEOF", []), ("sudo rm /x", ["/x"]), ("env A=1 rm /y", ["/y"]), ("sudo -n env B=2 nohup rm -f /z", ["/z"]),
        ("cat <<EOF\nrm /no\nEOF\nrm /yes", ["/yes"]), ("echo 'rm /no'; sudo ls /no", []), (None, None),
    ]
    got = spark.createDataFrame([(c,) for c, _ in rows], "c string").select("c", C.delete_targets(C.shell_text(C.expanded(F.col("c")))).alias("d")).collect()
    assert [(r.c, r.d or []) for r in got] == [(c, d or []) for c, d in rows]


def test_a_very_long_command_is_read(spark):
    long = "echo " + "x<<y 'q' " * 20_000 + "\nrm /end"
    assert spark.createDataFrame([(long,)], "c string").select(C.delete_targets(C.shell_text(F.col("c"))).alias("d")).first().d in ([], ["/end"])
