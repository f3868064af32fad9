"""What each route of a knowledge base does, as a function over its tables and a scope.

A `Store` holds tables by name; reading methods give DataFrames, writing methods a new Store whose changed tables are new
plans over the old ones: nothing is written before the caller does so. Every method asks only for rows that the scope
may see or change.

Tables: users, workspaces, memberships, invitations, documents, revisions, chunks, projects, grants, files, symbols,
relations, facts, links, config, components, sessions, audit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import access, catalog, graph, integrity, listing, providers, retrieval, workspaces
from quillmark.session import cut
from quillmark.sources import files as sources


@dataclass(frozen=True)
class Scope:
    """Who asks: a user in a workspace, with their department, role and the projects they may see."""

    workspace_id: object
    user_id: object = None
    department_id: str | None = None
    role: str = "viewer"
    project_ids: tuple = ()


class Denied(Exception):
    """The scope does not allow it."""


@dataclass(frozen=True)
class Store:
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def but(self, **changed: DataFrame) -> Store:
        return replace(self, tables={**self.tables, **changed})

    @staticmethod
    def at(spark: SparkSession, folder: str, names: list[str]) -> Store:
        return Store({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def write(self, folder: str, names: list[str] | None = None) -> None:
        """Write tables to a folder that is not read from: readers of the old one see no half of it."""
        for n in names or list(self.tables):
            self[n].write.mode("errorifexists").parquet(f"{folder}/{n}.parquet")

    # scopes

    def scope(self, user: object, requested: object = None) -> Scope:
        """The scope of a user in the requested workspace, else in their default or first one."""
        one = self["users"].filter(F.col("user_id") == F.lit(user))
        chosen = workspaces.chosen(one, self["memberships"], self["workspaces"], None if requested is None else F.lit(requested))
        row = workspaces.scopes(chosen, self["projects"], self["grants"]).first()
        if row is None:
            raise Denied("no workspace")
        return Scope(row["workspace_id"], user, row["department_id"], row["role"], tuple(row["allowed_project_ids"]))

    def require(self, scope: Scope, *roles: str) -> None:
        if scope.role not in roles:
            raise Denied(f"needs one of {', '.join(roles)}")

    def still(self, scope: Scope, projects: tuple = ()) -> Scope:
        """The scope as it is now, for work that goes on: refused if the user has left the workspace since, or may no
        longer see one of the projects that the work is about."""
        now = self.scope(scope.user_id, scope.workspace_id)
        if lost := [p for p in projects if p not in now.project_ids]:
            raise Denied(f"no longer allowed: {lost}")
        return now

    def my_workspaces(self, user: object) -> DataFrame:
        return workspaces.listed(self["memberships"].filter(F.col("user_id") == F.lit(user)), self["workspaces"]).orderBy("nth")

    def members(self, scope: Scope) -> DataFrame:
        own = self["memberships"].filter((F.col("workspace_id") == F.lit(scope.workspace_id)) & (F.col("status") == "active"))
        return access.members(own).orderBy("nth")

    def create_workspace(self, wanted: DataFrame) -> Store:
        spaces, members = workspaces.created(self["workspaces"], wanted)
        return self.but(workspaces=self["workspaces"].unionByName(spaces), memberships=self["memberships"].unionByName(members))

    def switch_default(self, user: object, workspace: object) -> Store:
        to = self["users"].filter(F.col("user_id") == F.lit(user)).select("user_id", F.lit(workspace).alias("workspace_id"))
        return self.but(users=workspaces.with_default(self["users"], self["memberships"], self["workspaces"], to))

    def change_member(self, scope: Scope, user: object, action: str, role: str | None = None) -> Store:
        """set_role, remove or leave; defaults that are lost are repaired."""
        spark = self["memberships"].sparkSession
        asked = spark.range(1).select(F.lit(scope.workspace_id).alias("workspace_id"), F.lit(scope.user_id).alias("actor_id"), F.lit(user).alias("user_id"), F.lit(action).alias("action"), F.lit(role).cast("string").alias("role"))
        after = workspaces.after_changes(self["memberships"], asked).drop("applied")
        return self.but(memberships=after, users=workspaces.repaired(self["users"], after, self["workspaces"]))

    def transfer_ownership(self, scope: Scope, user: object) -> Store:
        self.require(scope, "owner")
        one = self["memberships"].sparkSession.range(1)
        asked = one.select(F.lit(scope.workspace_id).alias("workspace_id"), F.lit(scope.user_id).alias("owner_id"), F.lit(user).alias("user_id"))
        members, spaces = workspaces.transferred(self["memberships"], self["workspaces"], asked)
        return self.but(memberships=members, workspaces=spaces)

    def invite(self, scope: Scope, invitations: DataFrame) -> Store:
        from quillmark.operators.protocol import upsert_invitations

        self.require(scope, "owner", "admin")
        return self.but(invitations=upsert_invitations(self["invitations"], invitations.filter(F.col("workspace_id") == F.lit(scope.workspace_id))))

    def revoke_invitation(self, scope: Scope, invitation: object, now: Column) -> Store:
        self.require(scope, "owner", "admin")
        asked = self["invitations"].sparkSession.range(1).select(F.lit(invitation).alias("invitation_id"), F.lit(scope.workspace_id).alias("workspace_id"))
        return self.but(invitations=workspaces.revoked(self["invitations"], asked, now))

    def accept_invitation(self, tokens: DataFrame, now: Column) -> Store:
        members, used, users = workspaces.accepted(self["memberships"], self["invitations"], tokens, now, self["users"])
        return self.but(memberships=members, invitations=used, users=users)

    def hand_over(self, handovers: DataFrame) -> Store:
        """Everything of the source users becomes the targets'; the sources are disabled."""
        after = workspaces.handed_over(self["memberships"], self["workspaces"], {n: self[n] for n in ("documents", "projects") if n in self.tables}, self["grants"], handovers)
        gone = handovers.select(F.col("source_id").alias("user_id"), F.lit(True).alias("_gone"))
        users = self["users"].join(gone, "user_id", "left").withColumn("status", F.when(F.col("_gone"), "disabled").otherwise(F.col("status"))).drop("_gone")
        return self.but(users=users, **after)

    # documents

    def knowledge(self, scope: Scope, source_type: str | None = None, scope_type: str | None = None) -> DataFrame:
        return listing.knowledge(self["documents"], self["chunks"], scope.workspace_id, scope.user_id, scope.department_id, source_type, scope_type)

    def readable(self, scope: Scope) -> DataFrame:
        return self["documents"].filter((F.col("workspace_id") == F.lit(scope.workspace_id)) & retrieval.visible(scope.user_id, scope.department_id))

    def manageable(self, scope: Scope) -> Column:
        own = (F.col("owner_user_id") == F.lit(scope.user_id)) | (F.col("created_by_user_id") == F.lit(scope.user_id))
        return (F.col("workspace_id") == F.lit(scope.workspace_id)) & (F.lit(scope.role in ("owner", "admin")) | (F.lit(scope.role == "editor") & own))

    def revisions(self, scope: Scope, document: object) -> DataFrame:
        one = self.readable(scope).filter(F.col("document_id") == F.lit(document)).select("document_id")
        return catalog.latest_first(catalog.only(self["revisions"], one, ["document_id"]), "document_id", "revision_no")

    def invalidate(self, scope: Scope, document: object, reason: str) -> Store:
        hit = self.manageable(scope) & (F.col("document_id") == F.lit(document))
        return self.but(documents=catalog.set_status(self["documents"], hit, "invalid", reason).drop("changed"))

    def restore(self, scope: Scope, document: object) -> Store:
        hit = self.manageable(scope) & (F.col("document_id") == F.lit(document))
        return self.but(documents=catalog.set_status(self["documents"], hit, "active").drop("changed"))

    def delete(self, scope: Scope, document: object) -> Store:
        """The document, its chunks and its revisions."""
        gone = self["documents"].filter(self.manageable(scope) & (F.col("document_id") == F.lit(document))).select("document_id")
        return self.but(**{n: catalog.without(self[n], gone, ["document_id"]) for n in ("documents", "chunks", "revisions") if n in self.tables})

    # code

    def projects(self, scope: Scope) -> DataFrame:
        own = self["projects"].filter((F.col("workspace_id") == F.lit(scope.workspace_id)) & (F.col("status") == "active"))
        return access.open_or_granted(own, self["grants"].filter("status = 'active'"), scope.user_id).orderBy("project_name", "project_id")

    def delete_projects(self, scope: Scope, ids: list) -> Store:
        """Projects that the scope owns, or any for owners and admins, with all that hangs on them."""
        may = F.lit(scope.role in ("owner", "admin")) | (F.col("owner_user_id") == F.lit(scope.user_id))
        gone = self["projects"].filter((F.col("workspace_id") == F.lit(scope.workspace_id)) & F.col("project_id").isin(ids) & may).select("project_id")
        return self.but(**{n: catalog.without(self[n], gone, ["project_id"]) for n in ("projects", "files", "symbols", "relations", "facts", "links", "config", "components", "grants") if n in self.tables})

    def one_project(self, scope: Scope, project: object) -> DataFrame:
        return self.projects(scope).filter(F.col("project_id") == F.lit(project))

    def of_project(self, scope: Scope, name: str, project: object, commit: str | None = None) -> DataFrame:
        """A table's rows of one version of a project that the scope may see."""
        return catalog.only(self[name], listing.pinned(self.one_project(scope, project), project, commit), ["project_id", "commit_hash"])

    def overview(self, scope: Scope, project: object) -> DataFrame:
        """The project with its counts."""
        counted = {n.removesuffix("s"): self.of_project(scope, n, project).select("project_id") for n in ("files", "symbols", "relations", "facts", "links")}
        return listing.scan_totals(self.one_project(scope, project), "project_id", **counted)

    def files(self, scope: Scope, project: object) -> DataFrame:
        """Its files with the number of their symbols and outgoing relations."""
        symbols = self.of_project(scope, "symbols", project)
        out = self["relations"].join(symbols.select(F.col("symbol_id").alias("source_symbol_id"), "file_id"), "source_symbol_id")
        return listing.scan_totals(self.of_project(scope, "files", project), "file_id", symbol=symbols.select("file_id"), relation=out.select("file_id")).orderBy("path")

    def inventory(self, scope: Scope, project: object, query: str = "", limit: int = 200, offset: int = 0, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
        return listing.inventory(self.of_project(scope, "files", project, commit), query, limit, offset)

    def architecture(self, scope: Scope, project: object, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Facts, and the links between them with both roles."""
        own = self.of_project(scope, "facts", project, commit)
        return listing.facts(own), listing.links(self.of_project(scope, "links", project, commit).drop("project_id", "commit_hash"), own)

    def config(self, scope: Scope, project: object, query: str = "", prefix: str = "", kinds: list[str] | None = None, formats: list[str] | None = None, limit: int = 100, offset: int = 0, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
        """A page of configuration facts and how many there are in all pages (limit 100 at most)."""
        rows = self.of_project(scope, "config", project, commit)
        words = listing.ALIASES.get(query.strip().lower(), [query.strip().lower()]) if query.strip() else []
        rows = rows.filter(T.has_any(F.lower(F.concat_ws(" ", "path", "key_path", "value")), words)) if words else rows
        rows = rows.filter(F.startswith("path", F.lit(prefix))) if prefix else rows
        rows = rows.filter(F.col("fact_type").isin(kinds)) if kinds else rows
        rows = rows.filter(F.col("config_format").isin(formats)) if formats else rows
        return access.page(rows, ["path", "line", "key_path"], limit, offset, 100), rows.agg(F.count("*").alias("count"))

    def source(self, scope: Scope, project: object, path: str, texts: DataFrame, start: int = 1, stop: int | None = None, commit: str | None = None) -> DataFrame:
        """Lines of a file of the project; texts (path, content) is read only for files that are known, and must be what
        was indexed."""
        known = self.of_project(scope, "files", project, commit).filter(F.col("path") == path)
        row = known.select("content_hash").first()
        if row is None:
            raise Denied("no such file")
        return sources.line_range(texts.filter(F.col("path") == path), start, stop, row["content_hash"])

    def symbols(self, scope: Scope, project: object, query: str = "", **options: object) -> DataFrame:
        return listing.symbols(self.one_project(scope, project), self["symbols"], self["files"], project, query, **options)

    def symbol(self, scope: Scope, symbol: object) -> dict[str, DataFrame]:
        """The symbol, its outgoing relations with their targets, and those that lead to it with their sources."""
        mine = catalog.only(self["symbols"].filter(F.col("symbol_id") == F.lit(symbol)), self.projects(scope).select("project_id"), ["project_id"])
        near = self["relations"]
        out = catalog.only(near, mine.select(F.col("symbol_id").alias("source_symbol_id")), ["source_symbol_id"])
        into = catalog.only(near, mine.select(F.col("symbol_id").alias("target_symbol_id")), ["target_symbol_id"])
        return {
            "symbol": mine.join(self["files"].select("file_id", "path"), "file_id"), "relations": listing.outgoing(out, self["symbols"], self["files"]).orderBy("relation_type", "target_ref"),
            "incoming": listing.incoming(into, self["symbols"], self["files"]).orderBy("relation_type", "source_path", "source_line"),
        }

    def call_chain(self, scope: Scope, project: object, symbol: int, max_depth: int = 4, max_nodes: int = 80) -> tuple[graph.Trace, DataFrame]:
        """What the symbol calls, breadth first, and the nodes with their facts."""
        own = self.of_project(scope, "symbols", project).select(F.col("symbol_id").alias("source_symbol_id"))
        calls = catalog.only(self["relations"].filter("relation_type = 'calls'"), own, ["source_symbol_id"]).withColumnsRenamed({"source_symbol_id": "source_id", "target_symbol_id": "target_id"})
        found = graph.trace(calls, symbol, max_depth, max_nodes)
        return found, graph.with_facts(found.nodes, self.of_project(scope, "facts", project).withColumnRenamed("source_symbol_id", "symbol_id"))

    # answers

    def evidence(self, scope: Scope, question: str, embedder: providers.Embedder = providers.hashed_vectors, top: int = 8, budget: int = 6_000, candidates: int = 20, rerank: Column | None = None) -> DataFrame:
        """Documents' evidence for a question: recall by vector and words under the scope, fused, reranked, as context
        under the budget: evidence_id, rank, document_id, content, context_level, context_tokens, warning.

        Without a parent, or past the budget, a hit's own text stands for its context. If the reranker fails, the first
        `top` of the fused ranking are taken and warning says `reranker_fallback`; if no context comes of them, the ranked
        hits themselves are the evidence. An empty search gives no rows."""
        from quillmark import api

        who = api.Scope(scope.workspace_id, scope.user_id, scope.department_id)
        vector = [float(x) for x in embedder([question])[0]]
        hits = cut(api.search(self["chunks"], self["documents"], who, vector, question, ["rag"], candidates))
        try:
            best, warning = cut(providers.reranked(hits, question, top, rerank).drop("rank").withColumnRenamed("new_rank", "rank")), None
        except Exception:  # noqa: BLE001  whatever the reranker is, its failure costs the order only
            best, warning = hits.filter(F.col("rank") <= top), "reranker_fallback"
        found = cut(retrieval.expand(best, self["chunks"].filter("chunk_level = 'parent'").select("chunk_id", "content"), budget))
        if found.isEmpty():
            found = best.select("rank", "chunk_id", "content", F.lit("child").alias("context_level"), T.token_estimate(F.col("content")).alias("context_tokens"))
        named = found.join(self["chunks"].select("chunk_id", "document_id"), "chunk_id")
        return named.select(F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"), "rank", "document_id", "content", "context_level", "context_tokens", F.lit(warning).cast("string").alias("warning"))

    # operation

    def ready(self, wanted: dict[str, dict[str, str]]) -> DataFrame:
        """What is missing of the tables; no rows: ready."""
        return integrity.readiness(next(iter(self.tables.values())).sparkSession, self.tables, wanted)

    def audited(self, path: str, event: str, outcome: str, actor: object = None, write: Callable[[DataFrame, str], None] | None = None) -> bool:
        """Add a row to the audit log; a failure is told, never raised."""
        spark = next(iter(self.tables.values())).sparkSession
        row = spark.range(1).select(F.lit(event).alias("event"), F.lit(outcome).alias("outcome"), F.lit(actor).cast("string").alias("actor_user_id"), F.current_timestamp().alias("at"))
        try:
            (write or (lambda df, to: df.write.mode("append").parquet(to)))(row, path)
        except Exception:  # noqa: BLE001
            return False
        return True


def document_metadata(files: DataFrame, scope: Scope, source_type: str, scope_type: str, author: str, project_name: str | None = None, workspace_name: str | None = None) -> DataFrame:
    """files (path, content binary): what is known of each document before it is read; owners follow from the scope."""
    title = F.element_at(F.split("path", "/"), -1)
    only = lambda kind, value: F.lit(value if scope_type == kind else None).cast("string")
    return files.select(
        F.lit(source_type).alias("source_type"), F.lit(scope.workspace_id).alias("workspace_id"), title.alias("title"), title.alias("source_name"), F.col("path").alias("source_path"), F.lit(project_name if source_type == "wiki" else None).cast("string").alias("project_name"),
        only("workspace", workspace_name).alias("workspace_name"), F.lit(author).alias("author"), F.lit(scope_type).alias("scope_type"), only("personal", scope.user_id).alias("owner_user_id"), F.lit(scope.user_id).cast("string").alias("created_by_user_id"), only("department", scope.department_id).alias("owner_department_id"), F.sha2("content", 256).alias("content_hash"),
    )


def uploaded(files: DataFrame, most_files: int, most_bytes: int, most_each: int) -> tuple[DataFrame, DataFrame]:
    """files (path, content binary) of a folder that a browser sent: those that may be stored, with their relative path
    below the folder's name, and why the others may not: a path that climbs or is absolute, a file or all of them too
    large, too many files. The folder's name is the first part of every path."""
    parts = T.upload_path(F.col("path"))
    rows = files.withColumns({"_parts": parts, "_size": F.octet_length("content")})
    totals = rows.agg(F.count("*").alias("_n"), F.sum("_size").alias("_all"))
    why = F.when(F.col("_parts").isNull() | (F.size("_parts") < 2), "path").when(F.col("_size") > most_each, "file_size").when(F.col("_n") > most_files, "file_count").when(F.col("_all") > most_bytes, "total_size")
    judged = rows.join(F.broadcast(totals)).withColumn("reason", why)
    good = judged.filter("reason is null").select(F.array_join(F.slice("_parts", F.lit(2), F.size("_parts") - 1), "/").alias("path"), F.get("_parts", F.lit(0)).alias("folder"), "content")
    return good, judged.filter("reason is not null").select("path", "reason")


__all__ = ["Denied", "Scope", "Store", "document_metadata", "uploaded"]
