"""Architecture and configuration rules on small projects whose facts are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.operators import architecture, facts, yamls

DESK = """import flask
desk = Flask(__name__)

@desk.route("/loans/<book>")
def lend(book):
    return book

@shelf.router.delete('/loans/{book}', status_code=204)
async def give_back(book):
    return None

@night.scheduled_job("cron", hour=2)
async def remind_late_readers():
    ...

@desk.on_event("shutdown")
def close_desk():
    ...

if __name__ == "__main__":
    desk.run()
"""
SHELVES = """amqp: none
KAFKA_BOOTSTRAP: broker.library:9092
kafka:
  loan_topic: loans.opened
  consumers:
    group: reminders
  secret_token: do-not-tell
mongodb:
  shelf_collection: shelves
  library_db: branches
  reader_url: mongodb://keeper:hush-hush@store.library:27017
catalogue:
  api:
    endpoint: https://catalogue.library/v2
GRPC_MEMBERS_ADDR: members.library:7000
"""
LOANS = """import aiokafka
import motor
import grpc
from members_pb2_grpc import MembersStub

class Loans:
    def __init__(self, channel, database):
        self.members = MembersStub(channel)
        self.rows = database["shelves"]

    def open(self, queue, reader):
        card = self.members.FindCard(reader)
        queue.publish("loans.opened", card)
        self.members.connect()
        return card
"""
COUNTER = """package counter

import (
	"google.golang.org/grpc"
)

func Open(conn *grpc.ClientConn) {
	fines := pb.NewFinesClient(conn)
	fines.Waive(ctx, id)
	fines.Close()
}
"""


@pytest.fixture(scope="module")
def project(spark):
    return lambda files: spark.createDataFrame(list(files.items()), "path string, content string")


def found(df):
    return {(r["fact_type"], r["name"], r["value"]): r for r in df.collect()}


def test_modules_entry_points_apis_and_jobs(project):
    proto = "syntax = 'proto3';\nservice Members {\n  rpc FindCard (stream Reader) returns (Card);\n  rpc Drop(Card)   returns (Nothing);\n}\n"
    got = found(architecture.extract(project({"library/desk/__init__.py": "", "library/desk/web.py": DESK, "idl/members.proto": proto})))
    for key in (
        ("module", "library.desk", "python_package"), ("entrypoint", "desk", "Flask application"), ("http_api", "lend", "ROUTE /loans/<book>"), ("http_api", "give_back", "DELETE /loans/{book}"), ("lifecycle_hook", "close_desk", "shutdown"),
        ("background_job", "remind_late_readers", "night.scheduled_job"), ("rpc_service", "Members", "grpc"), ("rpc_method", "FindCard", "stream Reader -> Card"), ("rpc_method", "Drop", "Card -> Nothing"), ("entrypoint", "library/desk/web.py", "python_main"),
    ):
        assert key in got
    handler = got["http_api", "give_back", "DELETE /loans/{book}"]
    assert (handler["line"], handler["evidence"]) == (9, "@shelf.router.delete('/loans/{book}', status_code=204)")


def test_what_is_generated_locked_or_tried_says_nothing(project):
    said = "import redis\nmembers = MembersStub(channel)\n"
    files = {"library/tests/desk.py": said, "examples/desk.py": said, "idl/members_pb2.py": said, "desk.gen.go": "package desk\nfunc main() {}\n", "poetry.lock": "redis-py = 1\n", "notes.txt": said, "desk/plain.py": "def stub():\n    return MembersStub\n", "counter/fines.go": "package fines\n\nfunc NewFinesClient() {}\n"}
    assert set(found(architecture.extract(project(files)))) == {("module", "counter", "go_package:fines")}


def test_resources_clients_and_credentials(project):
    rows = architecture.extract(project({"deploy/shelves.yml": SHELVES, "library/loans.py": LOANS, "counter/open.go": COUNTER}))
    got = {(r["fact_type"], r["name"]): r for r in rows.collect()}
    for key in (
        ("component", "Kafka"), ("component", "MongoDB"), ("component", "gRPC"), ("kafka_cluster", "KAFKA_BOOTSTRAP"), ("kafka_topic_config", "loans.opened"), ("kafka_topic_producer", "loans.opened"), ("kafka_consumer_group", "reminders"),
        ("mongo_collection", "shelves"), ("downstream_http", "api"), ("downstream_grpc", "Members"), ("downstream_grpc", "Fines"),
        ("client_initialization", "Members"), ("client_initialization", "Fines"), ("downstream_call", "Members.FindCard"), ("downstream_call", "Fines.Waive"),
    ):
        assert key in got, key
    assert (got["downstream_call", "Fines.Waive"]["path"], got["downstream_call", "Fines.Waive"]["evidence"], got["downstream_call", "Fines.Waive"]["line"]) == ("counter/open.go", "fines.Waive(", 9)
    assert got["downstream_call", "Members.FindCard"]["evidence"] == "self.members.FindCard("
    assert not {("downstream_call", "Members.connect"), ("downstream_call", "Fines.Close")} & set(got)
    said = " ".join(f"{r['name']} {r['value']} {r['evidence']}" for r in got.values())
    assert "do-not-tell" not in said and "hush-hush" not in said
    linked = {r["relation_type"] for r in facts.links(rows.withColumn("fact_id", F.xxhash64("fact_type", "name", "value", "path", "line"))).collect()}
    assert {"client_invokes", "configures_usage"} <= linked


def test_packages_scripts_and_examples(project):
    files = {"package.json": '{"name": "ui", "scripts": {"start": "vite",\n "dev": 3, "serve": "x"}}', "bad/package.json": "{", "n/package.json": '{"name": 5}', "go.mod": "module a.b/c\n", "cmd/main.go": "package main\n\nfunc main() {\n\tr.GET(\"/ping\", ping)\n\thttp.HandleFunc(\"/x\", func(w W) {})\n}\n", "lib/x.go": "package lib\nfunc main() {}\n", ".env.example": "ORDER_SERVICE_URL=http://o:1\n", ".env": "ORDER_SERVICE_URL=http://o:1\nstem_host=h\n"}
    got = found(architecture.extract(project(files)))
    assert {("module", "ui", "javascript_package"), ("entrypoint", "start", "vite"), ("entrypoint", "serve", "x"), ("module", "a.b/c", "go_module"), ("http_api", "ping", "GET /ping"), ("http_api", "ANY /x", "inline_handler"), ("entrypoint", "main", "go_main"), ("module", "cmd", "go_package:main"), ("downstream_http", "order-service", "http://o:1"), ("endpoint_config", "stem_host", "h")} <= set(got)
    assert {r["path"] for r in got.values() if r["fact_type"] in ("downstream_http", "entrypoint")} == {"package.json", "cmd/main.go", ".env"}
    assert got["entrypoint", "serve", "x"]["line"] == 2


def test_configuration_facts(project):
    compose = "services:\n  api:\n    image: example/api:1\n    depends_on:\n      - kafka\n  kafka:\n    ports: [1, 2]\n    depends_on:\n      zoo: {condition: up}\n"
    files = {"config/application.yaml": "server:\n  port: 8080\n  token: abc\n", "docker-compose.yml": compose, "templates/deployment.yaml": "kind: Deployment\nspec:\n  image: {{ .Values.image.repository }}\n", "x/templates/d.yaml": "kind: Job\nname: \"{{ .Values.image.tag }}\"\n", "values.yaml": "a: [1", "bad.yaml": "a: [1\n", "a.txt": "a: 1", "empty.yml": ""}
    rows = yamls.config_facts(project(files)).collect()
    at = {(r["path"], r["key_path"], r["fact_type"]): r for r in rows}
    port = at["config/application.yaml", "server.port", "config_key"]
    assert (port["line"], port["value"]) == (2, "8080") and at["config/application.yaml", "server.token", "config_key"]["value"] == "[REDACTED]"
    said = {(r["fact_type"], r["key_path"], r["value"], r["line"]) for r in rows if r["path"] == "docker-compose.yml"}
    assert {("service", "services.api", "api", 2), ("compose_image", "services.api.image", "example/api:1", 3), ("dependency", "services.api", "kafka", 4), ("compose_ports", "services.kafka.ports", "[1, 2]", 7), ("dependency", "services.kafka", "zoo", 8), ("config_key", "services.api.depends_on.0", "kafka", 5)} <= said
    helm = {(r["key_path"], r["value"], r["parse_status"]) for r in rows if r["path"] == "x/templates/d.yaml" and r["fact_type"] == "helm_template"}
    assert helm == {("kubernetes.kind", "Job", "parsed"), ("helm.Values", "image.tag", "partial")}
    assert at["bad.yaml", "$", "parse_error"]["value"] == "YAML parse failed" and at["values.yaml", "$", "helm_value"]["config_format"] == "helm_values"
    assert not [r for r in rows if r["path"] in ("a.txt", "empty.yml")]


def test_go_structure():
    source = 'package main\n\nimport (\n\t"fmt"\n)\n\n// run() {\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Get(k string) string {\n\tif k == "}" {\n\t\treturn fmt.Sprint(b.n)\n\t}\n\treturn helper(k)\n}\n\nfunc helper(s string) string { return s }\n'
    symbols, relations = facts.go_facts(source)
    assert [(s[0], s[2], s[4], s[5]) for s in symbols] == [("Box", "type", 8, 10), ("Get", "method", 12, 17), ("helper", "function", 19, 19)]
    assert {(r[0], r[1], r[2]) for r in relations if r[1] == "calls"} == {("Get", "calls", "fmt.Sprint"), ("Get", "calls", "helper")}
    assert [r[3:] for r in relations if r[1] == "imports"] == [(3, 0.9)]
