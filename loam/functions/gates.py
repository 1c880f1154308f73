"""Column predicates that decide what is worth keeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import alnum_ratio, trim_white

# User messages that only acknowledge.
ACKNOWLEDGMENTS = [
    "ok", "okay", "ok.", "okay.", "ok!", "thanks", "thank you", "thanks!", "thank you!", "sounds good", "sounds good!", "great", "great!", "great.", "perfect", "perfect!", "perfect.", "go ahead",
    "go ahead.", "yes", "yes.", "yes!", "yep", "yep.", "sure", "sure.", "please", "please do", "continue", "proceed", "got it", "got it.", "good", "good.", "👍", "lgtm",
]
# How answers begin that tell what was done.
PROCEDURAL = [
    "i'll ", "i will ", "i've ", "i have ", "i've made", "i've updated", "i've added", "i've removed", "i've changed", "i've fixed", "i've created", "i've modified", "i've implemented", "i've written",
    "i've completed", "i've finished", "i've done", "i've set", "i've moved", "i've deleted", "i looked at", "i made ", "i updated ", "i changed ", "i added ", "i removed ", "i fixed ", "i created ",
    "i modified ", "i implemented ", "i wrote ", "i ran ", "let me look", "let me check", "let me read", "let me see", "sure! ", "sure, i", "sure, let", "of course", "done! ", "done.", "absolutely",
]
# How answers begin that explain findings.
EXPLANATORY = [
    "i've ", "i have ", "i can see", "i can confirm", "i notice", "looking at ", "based on ", "after reviewing", "after looking", "i see that", "i found that", "i found the", "i checked",
    "the issue is", "the problem is", "the error is", "it appears", "it seems", "it looks like", "i've made", "i've updated", "i've added", "i've created", "i've fixed", "i've changed", "i've modified",
    "i've completed", "i've reviewed", "i've checked", "i've run", "i've tested", "the fix is", "the change is", "the solution is",
]
# How answers begin that only accompany work.
ACCOMPANYING = ["i'll ", "let me ", "sure", "ok", "done", "got it", "understood", "running", "checking", "opening", "reading", "searching", "i've ", "i have ", "here's the ", "proceeding", "continuing"]
# Words that make a result relevant to a topic.
TOPICS = {
    "go-patterns": ["goroutine", "interface", "context.context", "t.run", "error wrap", "defer", "channel", "struct embed"],
    "mongodb-ops": ["mongo", "atlas", "vectorsearch", "aggregat", "collection", "bulk write", "index", "pipeline"],
    "api-design": ["endpoint", "rest", "pagination", "rate limit", "http status", "cors", "health check", "idempoten"],
    "testing": ["test", "benchmark", "fuzz", "fixture", "assert", "mock", "golden", "snapshot"],
    "deployment": ["docker", "kubernetes", "deploy", "shutdown", "container", "distroless", "migration", "feature flag"],
    "security": ["auth", "jwt", "injection", "tls", "secret", "csp", "redact", "vulnerability", "cors"],
    "performance": ["pprof", "cache", "pool", "allocat", "latenc", "bulk", "compress", "index"],
    "error-handling": ["error", "retry", "circuit", "timeout", "panic", "backoff", "sentinel", "recover"],
    "concurrency": ["goroutine", "channel", "mutex", "waitgroup", "atomic", "worker", "semaphore", "errgroup"],
    "configuration": ["config", "environment", "flag", "reload", "default", "precedence", "secret ref", "validation"],
}


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return any_of([text.startswith(p) for p in prefixes])


def is_noise(text: Column, least: int = 40, ratio: float = 0.40) -> Column:
    clean = trim_white(text)
    return (F.octet_length(clean) < least) | (alnum_ratio(clean) < ratio)


def is_acknowledged_routine(user: Column, answer: Column) -> Column:
    """A mere acknowledgment answered by a report of what was done."""
    return F.lower(trim_white(user)).isin(ACKNOWLEDGMENTS) & starts_with_any(F.lower(trim_white(answer)), PROCEDURAL)


def is_short(answer: Column, least: int = 80) -> Column:
    return F.octet_length(trim_white(answer)) < least


def gate(user: Column, answer: Column, score: Column, synthesised: Column, least: int = 80, pre_gate: float = 0.35) -> Column:
    """The first gate that stops an exchange, or stored. score may be null (no scorer); synthesised: null (no model), or the model's reply."""
    return (
        F.when(is_acknowledged_routine(user, answer), "pre_filter")
        .when(is_short(answer, least), "length_filter")
        .when(score < pre_gate, "content_score_filter")
        .when(synthesised.isNull(), "no_synthesizer")
        .when(is_skip(synthesised), "synthesizer_skip")
        .otherwise("stored")
    )


def is_skip(reply: Column) -> Column:
    """A model's reply that declines: SKIP alone or leading, or a stage report."""
    clean = trim_white(reply)
    return (clean == "SKIP") | clean.rlike(r"^SKIP[\n ]") | clean.startswith("STAGE 1:") | clean.startswith("STAGE 2:")


def is_specific(text: Column) -> Column:
    """Code, calls, paths, errors or identifiers."""
    count = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    identifier = F.exists(words, lambda w: (F.octet_length(w) >= 4) & (w.rlike(r"^.+[A-Z]") | w.rlike("_.*_")))
    errors = any_of([text.contains(x) for x in ("Error:", "error:", "Exception", "panic:")])
    return text.contains("```") | ((count("(") > 2) & (count(")") > 2)) | (count("/") > 2) | errors | identifier


def response_class(text: Column) -> Column:
    """noise, explanation or substantive."""
    clean = trim_white(text)
    ratio, size = alnum_ratio(clean), F.octet_length(clean)
    explains = starts_with_any(F.lower(clean), EXPLANATORY)
    return (
        F.when((size < 20) | (ratio < 0.40), "noise")
        .when(explains & is_specific(clean), "substantive")
        .when(explains, "explanation")
        .when((size >= 60) & (ratio >= 0.50), "substantive")
        .otherwise("noise")
    )


def heuristic_label(answer: Column) -> Column:
    """noise, low or substantive by length and structure (lengths in characters)."""
    clean = trim_white(answer)
    size = F.length(clean)
    times = lambda s: (F.length(clean) - F.length(F.replace(clean, F.lit(s), F.lit("")))) / len(s)
    routine = r"(?i)^(let me |i'll |i need to |searching |running |checking |looking at |reading |now |opening |executing |starting )"
    structure = (times("\n- ") >= 3) | (times("\n* ") >= 3) | ((times("\n1.") >= 1) & (times("\n2.") >= 1))
    return (
        F.when(size < 80, "noise")
        .when((size < 200) & (starts_with_any(F.lower(clean), ACCOMPANYING) | clean.rlike(routine)), "noise")
        .when((size > 400) & clean.contains("```"), "substantive")
        .when((size > 800) & structure, "substantive")
        .when(size > 1200, "substantive")
        .otherwise("low")
    )


def junk_class(text: Column) -> Column:
    """What kind of leftover of a tool session a text is, first match first."""
    c = F.lower(text)
    head = lambda n: F.substring(c, 1, n)
    looks = any_of([head(150).contains(w) for w in ("search", "check", "look", "try", "examine")])
    return (
        F.when(c.contains("check if i have the permissions") | (c.contains("permission") & c.contains("repository")), "permission_check")
        .when(c.contains("<is_displaying_contents>") | c.contains("<filepaths>"), "grep_output_xml")
        .when(head(50).contains("command:") & (head(100).contains("grep") | head(200).contains("output:")), "command_output")
        .when(head(80).contains("let me") & looks, "let_me_search")
        .when(head(100).contains("warmup") | head(100).contains("i'll explore") | head(100).contains("i'll search"), "warmup_boilerplate")
        .when(c.contains("hyperswitch") | c.contains("/workspace/archit"), "codebase_exploration")
        .when(any_of([c.contains(w) for w in ("implementation", "based on my", "key findings", "here's what")]), "implementation_detail")
        .otherwise("other")
    )


def is_relevant(text: Column, topic: str) -> Column:
    return any_of([text.contains(w) for w in TOPICS[topic]])


def passes_quality(quality: Column, least: float = 0.05) -> Column:
    """Unscored rows, null or 0, pass."""
    return (F.coalesce(quality, F.lit(0.0)) == 0) | (quality >= least)


def below_store_gate(score: Column, least: float = 0.0) -> Column:
    """Is a chunk's content score too low to be stored? A gate of 0 is off."""
    return F.lit(False) if least <= 0 else F.coalesce(score < least, F.lit(False))
