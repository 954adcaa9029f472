"""Gates, checks and small renderings: each a column expression or one short plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import word_count

#: Terms by which a named capability counts as the planted one.
ERROR_TERMS = ("error", "failure", "failed", "failing", "traceback", "exception", "diagnostic", "feedback", "stderr", "message")
ACT_TERMS = ("adjust", "adapt", "correct", "revise", "modify", "amend", "act on", "acts on", "respond", "incorporate", "interpret", "parse", "read", "reads", "recover", "self-correct", "iterate")
RETRY_TERMS = ("retry", "retries", "repeat", "verbatim", "unchanged", "identical", "same call")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(text, t))


def planted_match(text: Column) -> Column:
    """strict for an error that is acted on or met by repetition, near for either alone, else none."""
    low = F.replace(F.lower(text), F.lit("_"), F.lit(" "))
    error, act, retry = _any(low, ERROR_TERMS), _any(low, ACT_TERMS), _any(low, RETRY_TERMS)
    return F.when(error & (act | retry), "strict").when(error | retry, "near").otherwise("none")


def trusted_pass(reward: Column, parse_status: Column, trustworthy: Column, timed_out: Column) -> Column:
    """Whether a rollout passed; null when its verdict can't be trusted. A timeout is a loss."""
    doubtful = F.coalesce(parse_status.isin("no_model_patch", "fallback_exitcode"), F.lit(False)) | F.coalesce(~trustworthy, F.lit(False))
    return F.when(timed_out, F.lit(False)).when(doubtful | reward.isNull(), F.lit(None).cast("boolean")).otherwise(reward >= 1.0)


def all_blocked(pairs: Column) -> Column:
    """Whether every host of ``host=code;...`` was out of reach, which a code that starts with 000 says."""
    codes = F.map_values(F.str_to_map(pairs, F.lit(";"), F.lit("=")))
    return (F.trim(pairs) != "") & F.forall(codes, lambda c: F.coalesce(c.startswith("000"), F.lit(False)))


def tokenizer_problems(left: Column, right: Column) -> Column:
    """What keeps two tokenizers (size, merges, vocab) apart; a hash on one side only is a problem, nothing compared is one."""
    found = []
    compared = F.lit(False)
    for name in ("size", "merges", "vocab"):
        a, b = left[name], right[name]
        compared = compared | (a.isNotNull() & b.isNotNull())
        found.append(F.when(a.isNotNull() & b.isNotNull() & (a != b), f"{name}_differs").when(a.isNull() != b.isNull(), f"{name}_one_sided"))
    found.append(F.when(~compared, "nothing_compared"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def valid_proof(oracle: Column, base: Column) -> Column:
    """A task is proven when its own solution passes and the unsolved state, where tried, fails."""
    return oracle & (base.isNull() | ~base)


def echo_shape_ok(logprobs: Column, expected: Column) -> Column:
    """As many echoed log probabilities as tokens, all of them finite numbers."""
    return (F.size(logprobs) == expected) & F.forall(logprobs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))


def verification_points(largest: Column, steps: Column, visited: Column, want: int) -> Column:
    """Unvisited prefixes to probe: the middle of those below and above the fork, then what is left, in order."""
    none = F.array().cast("array<int>")
    upto = lambda a, b: F.when(b > a, F.sequence(a, F.greatest(a, b - 1))).otherwise(none)
    zero = F.lit(0)
    below = F.array_except(upto(zero, F.coalesce(largest, zero)), visited)
    above = F.array_except(upto(F.coalesce(largest + 2, zero), steps), visited)
    middle = lambda p: F.when(F.size(p) > 0, F.array(p[F.floor(F.size(p) / 2).cast("int")])).otherwise(none)
    picks = F.concat(middle(below), middle(above))
    every = F.concat(picks, F.array_except(F.concat(below, above), picks))
    return F.array_sort(F.slice(every, 1, want))


def label_spans(lengths: Column, supervised: Column) -> Column:
    """[start, end) of the supervised turns among tokens, from each turn's token count, in one pass over the turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(held: Column, turn: Column) -> Column:
        end = held["at"] + turn["n"].cast("int")
        return F.struct(end.alias("at"), F.when(turn["s"], F.array_append(held["spans"], F.struct(held["at"].alias("start"), end.alias("end")))).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(F.arrays_zip(lengths.alias("n"), supervised.alias("s")), empty, step, lambda held: held["spans"])


def dropped_turns(first: Column, second: Column, limit: int) -> Column:
    """The fewest leading turns to drop so that what is left fits ``limit`` by both token counts, in one pass over the turns."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x.cast("int"))

    def step(held: Column, turn: Column) -> Column:
        fits = (held["a"] <= limit) & (held["b"] <= limit)
        less = lambda of, x: F.when(fits, held[of]).otherwise(held[of] - x.cast("int")).alias(of)
        return F.struct(less("a", turn["x"]), less("b", turn["y"]), F.when(fits, held["n"]).otherwise(held["n"] + 1).alias("n"))

    return F.aggregate(F.arrays_zip(first.alias("x"), second.alias("y")), F.struct(total(first).alias("a"), total(second).alias("b"), F.lit(0).alias("n")), step, lambda held: held["n"])


def ordered_results(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results of a turn in the order of their calls; an unknown id counts as the first."""
    at = calls.groupBy("turn", "call_id").agg(F.min("pos").alias("call_pos"))
    joined = results.join(at, ["turn", "call_id"], "left").withColumn("call_pos", F.coalesce("call_pos", F.lit(0)))
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy("call_pos", "pos")) - 1)


def targeted_command(command: Column, test_files: Column) -> Column:
    """A test command cut down to the files of the test patch, where its runner takes files and none is named yet."""
    ending = lambda *ends: F.filter(test_files, lambda f: F.exists(F.array(*(F.lit(e) for e in ends)), lambda e: F.endswith(f, e)))
    quoted = lambda fs: F.array_join(F.transform(fs, lambda f: F.when(f.rlike(r"^[\w@%+=:,./-]+$"), f).otherwise(F.concat(F.lit("'"), f, F.lit("'")))), " ")
    py, js, go = ending(".py"), ending(".js", ".ts", ".jsx", ".tsx"), ending("_test.go")
    packages = F.array_sort(F.array_distinct(F.transform(go, lambda f: F.when(F.contains(f, F.lit("/")), F.concat(F.lit("./"), F.regexp_replace(f, r"/[^/]*$", ""))).otherwise(F.lit(".")))))
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    named = F.exists(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: ~w.startswith("-") & (F.endswith(w, F.lit(".py")) | F.contains(w, F.lit("/"))))
    trimmed = F.rtrim(command)
    return (
        F.when(command.rlike(r"\bpytest\b") & (F.size(py) > 0), F.when(named, command).otherwise(F.concat(trimmed, F.lit(" "), quoted(py))))
        .when(command.rlike(r"\bgo\s+test\b") & (F.size(packages) > 0), F.when(F.contains(command, F.lit("./...")), F.replace(command, F.lit("./..."), F.array_join(packages, " "))).otherwise(F.concat(trimmed, F.lit(" "), F.array_join(packages, " "))))
        .when(command.rlike(r"\b(?:jest|mocha|vitest)\b") & (F.size(js) > 0), F.when(named, command).otherwise(F.concat(trimmed, F.lit(" "), quoted(js))))
        .otherwise(command)
    )


def duration_text(seconds: Column) -> Column:
    """Seconds as ``1h 02m``, ``3m 04s`` or ``5.0s``; a dash for none."""
    return (
        F.when(seconds.isNull(), "-")
        .when(seconds >= 3600, F.format_string("%dh %02dm", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)))
        .when(seconds >= 60, F.format_string("%dm %02ds", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60)))))
        .otherwise(F.format_string("%.1fs", seconds.cast("double")))
    )


#: The marks of a completion.
DSML, BOS, EOS, THINK, THINK_END = "｜DSML｜", "<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>", "<think>", "</think>"
CALLS, CALLS_END = f"\n\n<{DSML}tool_calls", f"</{DSML}tool_calls>"


def _parameter(group: str) -> str:
    """The form of a parameter; ``group`` opens the groups of its name, kind and value."""
    return rf'<{DSML}parameter name="{group}(?:(?!">).)*?)" string="{group}true|false)">{group}(?:(?!/{DSML}parameter).)*)</{DSML}parameter>\n'


_PARAMETER = _parameter("(")
_INVOKE = rf'<{DSML}invoke\s*name="((?:(?!<{DSML}parameter|</{DSML}invoke).)*?)">\n(?:{_parameter("(?:")})*</{DSML}invoke>\n'


def rendered_call(name: Column, parameters: Column) -> Column:
    """A tool call with its parameters (name, value, is_string) in the marked form that completions use."""
    one = lambda p: F.concat(F.lit(f'<{DSML}parameter name="'), p["name"], F.when(p["is_string"], '" string="true">').otherwise('" string="false">'), p["value"], F.lit(f"</{DSML}parameter>\n"))
    return F.concat(F.lit(f'<{DSML}invoke name="'), name, F.lit('">\n'), F.array_join(F.transform(parameters, one), ""), F.lit(f"</{DSML}invoke>\n"))


def rendered_completion(reasoning: Column, content: Column, calls: Column) -> Column:
    """A whole completion: thinking, answer, rendered calls, end mark."""
    block = F.when(F.size(calls) > 0, F.concat(F.lit(f"{CALLS}>\n"), F.array_join(calls, ""), F.lit(CALLS_END))).otherwise(F.lit(""))
    return F.concat(F.coalesce(reasoning, F.lit("")), F.lit(THINK_END), F.coalesce(content, F.lit("")), block, F.lit(EOS))


def parsed_completion(text: Column, thinking: bool = True, strict: bool = False) -> Column:
    """(reasoning, content, calls ARRAY<STRUCT<name, arguments>>, error) of a completion by its strict grammar.

    ``error`` says what is wrong, and then the rest is null: ``thinking``, ``end``, ``tool_calls``, ``duplicate_parameter``
    or ``special_token``; ``strict`` raises instead. ``arguments`` is a JSON object, with the values of parameters that
    aren't strings as they stand.
    """
    at = lambda mark, of: F.locate(mark, of)
    think, call = at(THINK_END, text), at(CALLS, text)
    thought = (think > 0) & ((call == 0) | (think < call)) if thinking else F.lit(True)
    reasoning = F.left(text, think - 1) if thinking else F.lit("")
    rest = F.substr(text, think + F.lit(len(THINK_END))) if thinking else text
    end, begin = at(EOS, rest), at(CALLS, rest)
    calling = (begin > 0) & ((end == 0) | (begin < end))
    content = F.left(rest, F.when(calling, begin).otherwise(end) - 1)
    block = F.substr(rest, begin + F.lit(len(CALLS)))
    well_formed = block.rlike(rf"(?s)\A>\n(?:{_INVOKE})*{CALLS_END}(?:{EOS})?\z")
    found = F.regexp_extract_all(block, F.lit(rf"(?s){_INVOKE}"), F.lit(0))
    parameters = lambda c, k: F.regexp_extract_all(c, F.lit(rf"(?s){_PARAMETER}"), F.lit(k))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", "")
    member = lambda p: F.concat(quoted(p["n"]), F.lit(": "), F.when(p["s"] == "true", quoted(p["v"])).otherwise(p["v"]))
    arguments = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.arrays_zip(parameters(c, 1).alias("n"), parameters(c, 2).alias("s"), parameters(c, 3).alias("v")), member), ", "), F.lit("}"))
    calls = F.transform(found, lambda c: F.struct(F.regexp_extract(c, rf"(?s){_INVOKE}", 1).alias("name"), arguments(c).alias("arguments")))
    twice = F.exists(found, lambda c: F.size(F.array_distinct(parameters(c, 1))) < F.size(parameters(c, 1)))
    special = lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(m)), True) for m in (BOS, EOS, THINK, THINK_END, DSML)), F.lit(False))
    error = (
        F.when(~thought, "thinking")
        .when(~calling & ((end == 0) | (F.length(rest) != end + F.lit(len(EOS) - 1))), "end")
        .when(calling & ~well_formed, "tool_calls")
        .when(calling & twice, "duplicate_parameter")
        .when(special(content) | special(reasoning), "special_token")
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("malformed completion: "), error)).cast("string"))
    sound = error.isNull()
    none = F.array().cast("array<struct<name: string, arguments: string>>")
    return F.when(text.isNotNull(), F.struct(F.when(sound, reasoning).alias("reasoning"), F.when(sound, content).alias("content"), F.when(sound, F.when(calling, calls).otherwise(none)).alias("calls"), error.alias("error")))


def rendered_chat(messages: DataFrame) -> DataFrame:
    """Each run's messages (run_id, idx, role, content) as one prompt."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.coalesce("content", F.lit("")), F.lit("<|end|>\n"))
    return messages.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "turn_id", line.alias("x")))), lambda m: m["x"]), "").alias("prompt"))


def capture_verdict(captures: DataFrame) -> DataFrame:
    """One row: how many captures lack what, and what that allows."""
    counted = captures.agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(F.col("started").isNull()).alias("no_start"), F.count_if(F.coalesce(F.size("ids"), F.lit(0)) <= 0).alias("no_ids")
    )
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("no_ids") > 0, "unusable").when((F.col("no_text") > 0) | (F.col("no_start") > 0), "partial").otherwise("complete")
    return counted.withColumn("verdict", verdict)
