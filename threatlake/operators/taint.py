"""Taint flows as joins over fact tables; every join is an equi-join on the file and an id within it.

Facts are a dict of DataFrames: scopes (scope_id, parent_id, scope_path),
literals, calls, args, declarations, references.  What encloses what stands in
their labels (``in_args``, ``in_inits``, ``assigned_to``, ``first_lit``), so that no
join compares spans and none is keyed by the file alone: a single large file
spreads over all partitions.  Scopes relate by exploding one side's
``scope_path`` and joining on the scope; ``scope_closure`` gives all ancestors.

A reference resolves only to a declaration of the same scope that comes before
it; with ``fixes`` also to one of an enclosing scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXT_CALLS, CRYPTO_CALLS, ENTROPY_LIMIT, EXEC_CALLS, EXEC_MODULE, KEY_ARGUMENT
from .findings import finding, lookup
from .patterns import rc4_confidence, rc4_indicators


#: Characters and bytes of a key that a finding shows, and so many characters tell what it shows.
SHOWN, VALUE_CHARS = 32, 33
#: Rows that a task of ``by_file`` gets; the sorts of all its joins wait in memory at once.
FILE_ROWS = 50_000


def by_file(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` of ``df`` dealt by ``path``: all joins and counts of flows on tables made from it then take place where the rows lie.

    For many files: they are shuffled once, not again for every join, and one file's rows are one task's work.
    """
    spark = df.sparkSession
    # else Spark deals both sides of a join anew by all of its keys, though the rows of a path lie together already
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS)), "path")


def _scoped(df: DataFrame, facts: dict[str, DataFrame], name: str) -> DataFrame:
    """``df`` with the scopes around its ``scope_id``, that one included."""
    return df.join(facts["scopes"].select("path", "scope_id", F.col("scope_path").alias(name)), ["path", "scope_id"])


def resolved(facts: dict[str, DataFrame], fixes: bool = False) -> DataFrame:
    """(path, ref_seq, in_args, in_inits, symbol_id): the first declaration seen that a reference names.

    Of a scope's declarations of one name only the first can be it, so each
    reference meets one row per scope.
    """
    columns = ["path", "ref_seq", "in_args", "in_inits"]
    r = facts["references"]
    # both numbers in one, whose least is found without a sort
    least = F.min(F.shiftleft(F.col("node_seq").cast("long"), 32) + F.col("symbol_id")).alias("first")
    d = facts["declarations"].groupBy("path", "name", F.col("scope_id").alias("in_scope")).agg(least)
    before, symbol = F.shiftright("first", 32) < F.col("node_seq"), F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("symbol_id")
    if not fixes:
        return r.withColumnRenamed("scope_id", "in_scope").join(d, ["path", "name", "in_scope"]).where(before).select(*columns, symbol)
    up = _scoped(r, facts, "up").select(*columns, "name", "node_seq", F.explode("up").alias("in_scope"))
    found = up.join(d, ["path", "name", "in_scope"]).where(before)
    return found.groupBy(*columns).agg(F.min("first").alias("first")).select(*columns, symbol)


def symbol_calls(refs: DataFrame) -> DataFrame:
    """Distinct (path, symbol_id, call_seq): the symbol is named within an argument of the call."""
    return refs.select("path", "symbol_id", F.explode("in_args.call_seq").alias("call_seq")).distinct()


def argument_literals(facts: dict[str, DataFrame], refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, call_seq, value) for the arguments ``wanted`` (path, call_seq, arg_idx, first_lit).

    The first literal inside the argument, else the first inside the initializer
    of a declaration that a reference in the argument names.
    """
    named = refs.select("path", "ref_seq", "symbol_id", F.explode("in_args").alias("a")).select("path", "ref_seq", "symbol_id", "a.*")
    hops = named.join(wanted.select("path", "call_seq", "arg_idx"), ["path", "call_seq", "arg_idx"])
    hops = hops.join(facts["declarations"].where("first_lit IS NOT NULL").select("path", "symbol_id", "first_lit"), ["path", "symbol_id"])
    hop = hops.groupBy("path", "call_seq").agg(F.min_by("first_lit", "ref_seq").alias("hop"))
    meant = wanted.join(hop, ["path", "call_seq"], "left").select("path", "call_seq", F.coalesce("first_lit", "hop").alias("lit_seq"))
    return meant.join(facts["literals"].select("path", "lit_seq", "value"), ["path", "lit_seq"], "left").select("path", "call_seq", "value")


def taint_sources(facts: dict[str, DataFrame], refs: DataFrame) -> DataFrame:
    """High-entropy literals, header accesses and cryptographic calls in one table, with what each is assigned to."""
    literals, calls = facts["literals"], facts["calls"]
    columns = ["span_start", "span_end", "scope_id", "place", "at_line", "assigned_to"]
    none = lambda name: F.lit(None).cast("string").alias(name)
    source_id = lambda prefix, seq: F.concat(F.lit(prefix), F.format_string("%09d", seq)).alias("source_id")
    dense = literals.where(F.col("entropy") > ENTROPY_LIMIT)
    dense = dense.select("path", source_id("0:", "lit_seq"), F.lit("high_entropy").alias("kind"), none("method"), none("key_value"), *columns)
    header = calls.where(F.array_contains("callee_chain", "headers"))
    header = header.select("path", source_id("1:", "call_seq"), F.lit("http_header").alias("kind"), F.col("callee").alias("method"), none("key_value"), *columns)
    crypto = calls.where(F.col("callee").isin(CRYPTO_CALLS) | F.array_contains("callee_chain", "crypto"))
    keyed = crypto.select("path", "call_seq", lookup(KEY_ARGUMENT, F.col("callee")).cast("int").alias("arg_idx"))
    keyed = keyed.join(facts["args"].select("path", "call_seq", "arg_idx", "first_lit"), ["path", "call_seq", "arg_idx"])
    keys = argument_literals(facts, refs, keyed).withColumnRenamed("value", "key_value")
    crypto = crypto.join(keys, ["path", "call_seq"], "left")
    crypto = crypto.select("path", source_id("2:", "call_seq"), F.lit("crypto").alias("kind"), F.col("callee").alias("method"), "key_value", *columns)
    return dense.unionByName(header).unionByName(crypto)


def taint_sinks(facts: dict[str, DataFrame]) -> DataFrame:
    """(path, call_seq, sink, scope_id, place, at_line): calls that run code."""
    chain, last = F.col("callee_chain"), F.coalesce(F.try_element_at("callee_chain", F.lit(-1)), F.col("callee"))
    kind = (
        F.when(F.col("callee") == "eval", "eval")
        .when(F.col("callee") == "Function", "function_constructor")
        .when((F.size(chain) == 2) & (F.get(chain, 0) == EXEC_MODULE) & F.get(chain, 1).isin(EXEC_CALLS), "child_process_exec")
        .when(last.isin(CONTEXT_CALLS), "vm_run_in_context")
    )
    return facts["calls"].withColumn("sink", kind).where("sink IS NOT NULL").select("path", "call_seq", "sink", "scope_id", "place", "at_line")


def related_scopes(a: DataFrame, b: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """All pairs of ``a`` (path, scope_id, …) and ``b`` (path, b_scope, …) of which one's scope is the other's or encloses it.

    One equi-join on (path, scope, way): a row of ``a`` waits at its own scope for
    those that stand in or below it, and goes to each scope strictly around it
    for those that stand there.  Rows of sibling scopes never meet.
    """
    at = lambda scope, way: F.struct(scope.alias("meet"), F.lit(way).alias("way"))
    around = lambda own, way: F.transform(F.filter("up", lambda x: x != F.col(own)), lambda x: at(x, way))
    left = _scoped(a, facts, "up").withColumn("_m", F.explode(F.concat(F.array(at(F.col("scope_id"), "below")), around("scope_id", "above"))))
    right = _scoped(b.withColumnRenamed("b_scope", "scope_id"), facts, "up").withColumnRenamed("scope_id", "b_scope")
    right = right.withColumn("_m", F.explode(F.concat(F.array(at(F.col("b_scope"), "below"), at(F.col("b_scope"), "above")), around("b_scope", "below"))))
    left, right = (df.select("*", "_m.*").drop("up", "_m") for df in (left, right))
    return left.join(right, ["path", "meet", "way"]).drop("meet", "way")


def taint_flows(facts: dict[str, DataFrame], fixes: bool = False, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(path, source_id, kind, method, key_value, place, at_line, sink, sink_seq, flow): direct, transitive and same-scope flows.

    A transitive flow comes once per reference and declaration it passes, and
    does not suppress the same-scope flow of its pair; a direct one does.
    """
    # a reference outside all arguments and initialisers carries nothing on
    refs = resolved({**facts, "references": facts["references"].where("size(in_args) > 0 OR size(in_inits) > 0")}, fixes)
    source, sinks = taint_sources(facts, refs), taint_sinks(facts)
    sink = sinks.select("path", F.col("call_seq").alias("sink_seq"), "sink", F.col("scope_id").alias("b_scope"))
    named = refs.select("path", "symbol_id", F.explode("in_args.call_seq").alias("sink_seq"))
    reach = kept(named.join(sink.drop("b_scope"), ["path", "sink_seq"]).distinct())
    source = source.select("path", "source_id", "kind", "method", "key_value", "place", "at_line", "scope_id", "assigned_to")
    columns = ["path", "source_id", "kind", "method", "key_value", "place", "at_line", "sink", "sink_seq"]
    direct = source.join(reach.withColumnRenamed("symbol_id", "assigned_to"), ["path", "assigned_to"]).select(*columns)
    done = direct.select("path", "source_id", "sink_seq")
    via = refs.select("path", F.col("symbol_id").alias("assigned_to"), F.explode("in_inits").alias("symbol_id"))
    hop = via.join(reach, ["path", "symbol_id"]).drop("symbol_id")
    transitive = source.join(hop, ["path", "assigned_to"]).select(*columns).join(done, ["path", "source_id", "sink_seq"], "left_anti")
    same = related_scopes(source, sink, facts).select(*columns).join(done, ["path", "source_id", "sink_seq"], "left_anti")
    told = lambda df, flow: df.select(*columns, F.lit(flow).alias("flow"))
    return told(direct, "direct").unionByName(told(transitive, "transitive")).unionByName(told(same, "same_scope"))


def scope_closure(scopes: DataFrame) -> DataFrame:
    """(path, ancestor, scope_id), reflexive: every scope on the way from the file's own scope, without recursion."""
    return scopes.select("path", F.explode("scope_path").alias("ancestor"), "scope_id")


def source_in_scope(facts: dict[str, DataFrame], sources: DataFrame, scopes: DataFrame) -> DataFrame:
    """The distinct ``scopes`` (path, scope_id) that hold a source in themselves or in an enclosing scope."""
    own = sources.select("path", F.col("scope_id").alias("around")).distinct()
    around = _scoped(scopes.select("path", "scope_id"), facts, "up").select("path", "scope_id", F.explode("up").alias("around"))
    return around.join(own, ["path", "around"], "left_semi").select("path", "scope_id").distinct()


def semantic_findings(files: DataFrame, facts: dict[str, DataFrame], fixes: bool = False) -> DataFrame:
    """The four flow detectors over files with facts.

    Flows are computed once; every flow makes a finding for each detector whose condition it meets.
    The "line" of a finding is its source's character number, with ``fixes`` its line.
    """
    # joins carry what is shown of a key, not the whole
    facts = {**facts, "literals": facts["literals"].withColumn("value", F.left("value", F.lit(VALUE_CHARS)))}
    header = facts["calls"].where(F.array_contains("callee_chain", "headers")).select(F.col("path").alias("_h")).distinct()
    flows = taint_flows(facts, fixes).where("kind <> 'http_header'").join(header, F.col("path") == F.col("_h"), "left")
    sink, weak = F.col("sink"), F.col("flow") == "same_scope"
    key = F.when(F.octet_length("key_value") > SHOWN, F.concat(F.left("key_value", F.lit(SHOWN)), F.lit("..."))).otherwise(F.col("key_value"))
    grade = lambda high, low: F.when(weak, low).otherwise(high)
    hit = lambda when, detector, order, category, severity, text: F.when(
        when, F.struct(F.lit(detector).alias("rule"), F.lit(order).cast("bigint").alias("seq"), F.lit(category).alias("category"), severity.alias("severity"), text.alias("text"))
    )
    crypto = F.col("kind") == "crypto"
    hits = F.array(
        hit(F.col("kind") == "high_entropy", "GW005", 7, "encrypted_payload", grade("high", "medium"), F.concat(F.lit("Literal of high entropy flows to "), sink, F.lit(" (flow: "), F.col("flow"), F.lit(")"))),
        hit(crypto & F.col("key_value").isNotNull(), "GW006", 8, "hardcoded_key_decryption", grade("high", "medium"), F.concat(F.lit("Decryption by "), F.col("method"), F.lit(" with key '"), key, F.lit("' flows to "), sink)),
        hit(crypto & F.col("_h").isNotNull(), "GW008", 10, "header_c2", grade("critical", "high"), F.concat(F.lit("Header access and "), F.col("method"), F.lit(" flow to "), sink)),
    )
    found = flows.select("path", "place", "at_line", F.explode(F.array_compact(hits)).alias("h")).select("path", "place", "at_line", "h.*").withColumn("sure", F.lit(None).cast("double"))
    first = taint_sinks(facts).groupBy("path").agg(F.min_by(F.struct("place", "at_line", "sink"), "call_seq").alias("first"))
    kinds = files.select(F.col("path").alias("_k"), rc4_indicators(F.col("content")).alias("kinds")).where("size(kinds) >= 3")
    rc4 = first.join(kinds, F.col("path") == F.col("_k")).select(
        "path", "first.place", "first.at_line", F.lit("GW007").alias("rule"), F.lit(9).cast("bigint").alias("seq"), F.lit("rc4_pattern").alias("category"), F.lit("info").alias("severity"),
        F.concat(F.lit("Hand-made stream cipher near "), F.col("first.sink"), F.lit(": "), F.array_join("kinds", ", ")).alias("text"), rc4_confidence(F.size("kinds")).alias("sure"),
    )
    rows = found.unionByName(rc4).withColumns({"line": F.col("at_line" if fixes else "place").cast("bigint"), "column": F.lit(1).cast("bigint")})
    return finding(
        rows, "flows", 0, category=F.col("category"), severity=F.col("severity"), description=F.col("text"), remediation="Review what is decoded and run.", character=F.lit(None).cast("string"), confidence=F.col("sure"),
        detector=F.col("rule"), emit_seq=F.col("seq"),
    )
