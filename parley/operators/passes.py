"""Facts of conversations by ordered passes that claim what they read.

1. A message is masked (``mentions``). Passes run in their order; each find is a candidate with its place. Candidates are
   taken by pass and place, and one that overlaps what was taken before is dropped: the more specific pass has the words.
2. The clause around a candidate decides: negated, conditional or doubtful claims make no fact; a user's question or wish
   that names a choice is a proposal.
3. A proposal becomes a decision where the next turn (system turns aside) is an assistant's that accepts it.
4. In a session a fact counts once, at its first turn; a decision that another one says in more words goes, too.

A label is the object of its verb; in the passive it is the subject, found by walking back from the verb to where its noun
phrase begins, and the verb is put back in front ("the login page was merged" is "Merge login page"). Messages of tools and
of other languages give only what has a form of its own: files, routes, exceptions, packages.

Steps 1 and 2 look at one message and so are the same in batch and stream (``parley.streaming.sessions``). All of it is
built-in expressions; what a message gives is all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.weave import let
from parley.operators import extract
from parley.operators.mentions import finds, mask
from parley.sources.settle import settled

# What links another clause ends an object.
LINKS = r"(?:and|but|so|because|since|which|that|when|while|if|then|although|though|after|before|until|unless)"
OBJECT = rf"((?:(?!\s{LINKS}\b)[^.!?;:,()\n]|\.(?=\w)){{3,90}})"
LINE = r"([^\n]{3,160})"
NAME = r"([\w+#/-]+(?:\.\w+)*)"
SUBJECT = r"((?:[\w'/@#+-]+(?:\.\w+)* ){0,7}[\w'/@#+-]+(?:\.\w+)*)"
# Verbs of finished work with the base form where it is not the form without -ed or -d.
DONE = (
    "added fixed implemented finished completed created updated removed wrote migrated shipped merged deployed refactored renamed resolved built tested documented "
    "installed configured extracted replaced upgraded enabled disabled rewrote wired released patched moved"
).split()
BASE = {"wrote": "write", "written": "write", "built": "build", "rewrote": "rewrite", "rewritten": "rewrite", "done": "finish", "complete": "complete", "shipped": "ship", "resolved": "resolve"}
WORK = "add fix implement finish complete create update remove write migrate ship merge deploy refactor rename resolve build test document install configure extract replace upgrade enable disable rewrite wire release patch move review check verify set clean investigate handle support".split()
STOPS = "the a an and but so then that which because since when while after before i we you it they he she this these those our my your now also just already today finally both all".split()

_ed = "|".join(DONE)
_base = "|".join(WORK)
_gerunds = "|".join(sorted({*(w + "ing" for w in WORK), *(w[:-1] + "ing" for w in WORK if w.endswith("e")), "shipping", "setting"}))

#: ``(kind, pattern, group of the label, group of what it replaces or of its verb)``, the more specific first.
PASSES: list[tuple[str, str, int, int]] = [
    ("task_done", rf"(?im)^[ \t]*[-*] \[[xX]\][ \t]+{LINE}$", 1, 0),
    ("task_todo", rf"(?im)^[ \t]*[-*] \[ \][ \t]+{LINE}$", 1, 0),
    ("task_done", rf"(?im)^[ \t]*(?:[-*][ \t]+)?(?:fixed|done|implemented|resolved|added|shipped|finished|completed):[ \t]*{LINE}$", 1, 0),
    ("task_todo", rf"(?im)^[ \t]*(?:[-*][ \t]+)?(?:todo|to do|next|next steps?|remaining|action items?|follow-?up):[ \t]*{LINE}$", 1, 0),
    ("error", rf"(?im)^[ \t]*(?:[-*][ \t]+)?(?:bug|error|problem|issue|blocker|known issue):[ \t]*{LINE}$", 1, 0),
    ("decision", rf"(?im)^[ \t]*(?:[-*][ \t]+)?(?:decision|decided|chosen):[ \t]*{LINE}$", 1, 0),
    ("change", rf"(?i)\b(?:switch|switched|switching|move|moved|moving|migrate|migrated|migrating) from {NAME} to {NAME}", 2, 1),
    ("change", rf"(?i)\b(?:replace|replaced|replacing) {NAME} with {NAME}", 2, 1),
    ("change", rf"(?i)\b(?:use|using|chose|picked|prefer) {NAME} (?:instead of|over|rather than) {NAME}", 1, 2),
    ("goal", rf"(?i)\b(?:(?:the|our|my) (?:goal|aim|objective)(?: here| today| this \w+)? is(?: to)?|(?:i|we) (?:want|would like) to|(?:i|we)'d like to|(?:i'm|we're|i am|we are) (?:trying|looking|hoping) to|help (?:me|us)(?: to)?|let's build) {OBJECT}", 1, 0),
    ("task_wip", rf"(?i)\b(?:(?:i'm|i am|we're|we are|currently|still) (?:currently |still |now )?(?:working on|in the middle of)|(?:i'm|i am|we're|we are|currently) (?:currently |still |now )?(?:{_gerunds})|started (?:on|with|working on)) {OBJECT}", 1, 0),
    ("task_todo", rf"(?i)\b(?:needs? to|have to|has to|must|should|remember to|still to|don't forget to|(?:i|we)'ll|(?:i|we) will|going to|next up is to|next is to) ((?:{_base})\b{OBJECT[1:-1]})", 1, 0),
    ("decision", rf"(?i)\b(?:(?:decided|agreed|chose|opted|settled) (?:to use|to go with|to keep|to adopt|on|for)|(?:we|i)(?:'ll| will| are going to) (?:use|go with|stick with|keep|adopt)|let's (?:use|go with|stick with|keep|adopt)|going with|sticking with|the plan is to use|(?:we|i) (?:chose|picked|adopted)) {OBJECT}", 1, 0),
    ("proposal", rf"(?i)\b(?:(?:can|could|should|shall) (?:we|i) (?:use|go with|switch to|try|adopt)|(?:what|how) about(?: using)?|maybe (?:use|go with)|(?:we|i) (?:could|might) (?:use|go with|try)|would it be better to use) {OBJECT}", 1, 0),
    ("task_done", rf"(?i)\b(?:i|we|i've|we've|have|has|just|already|now|and|also|successfully) (?:have |has |just |already |now |also |successfully )*({_ed}) {OBJECT}", 2, 1),
    ("task_done", rf"(?i)\b{SUBJECT} (?:is|are|was|were|has been|have been) (?:now |already |all |finally )?({_ed}|done|complete|written|rewritten)\b", 1, 2),
    ("error", rf"(?i)\b{SUBJECT} (?:is|are|keeps|keep) (?:now |still |always )?(?:failing|broken|crashing|timing out|not working|down)\b", 1, 0),
    ("error", rf"(?i)\b(?:getting|got|hit|seeing|throws|raises|(?:fails?|failed|failing|crash(?:es|ed)?) with) (?:an? |the )?{OBJECT}", 1, 0),
]
NEGATED = r"(?i)\b(?:not|never|no longer|hasn't|haven't|isn't|aren't|wasn't|weren't|didn't|don't|doesn't|won't|can't|cannot|without|nobody|nothing)(?:\s+[\w']+){0,4}\s*$"
CONDITION = r"(?i)^\W*(?:and |but |so |then )?(?:if|once|when|whenever|after|unless|until|before|assuming|in case|as soon as)\b"
DOUBT = r"(?i)\b(?:could|would|might|maybe|perhaps|probably|whether|imagine|suppose)\b"
INNER_NEGATION = r"(?i)\b(?:not|never|no longer)\b"
YES = r"(?i)^\W*(?:yes|yeah|yep|sure|ok|okay|agreed|sounds good|good idea|great idea|makes sense|absolutely|of course|done|let's do (?:it|that)|go ahead|works for me|that works|perfect)\b"
NO = r"(?i)\b(?:but|however|instead|rather|not|don't|no)\b"
KINDS_OF_FORM = ["file", "endpoint", "error", "status", "dependency", "environment"]
PER_PART = 50_000  # messages or facts that one task takes
SCHEMA = "array<struct<pass:int,start:int,stop:int,kind:string,label:string,other:string>>"


def looks_english(text: Column, least: int = 2) -> Column:
    """Unless two function words at least are another language's and no fewer are English, or most letters are not Latin."""

    def told(parts: Column) -> Column:
        counts = dict(zip(T.FUNCTION_WORDS, T.scores_of_words(parts), strict=True))
        english, others = counts.pop("en"), F.greatest(*counts.values())
        return let(F.struct(english.alias("english"), others.alias("others")), lambda n: ~((n["others"] >= least) & (2 * n["others"] >= n["english"])))

    # A text is cut once, and each language looks only at what is a function word of any.
    known = sorted({w for own in T.FUNCTION_WORDS.values() for w in own})
    letters, latin = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.regexp_replace(text, r"[^\p{IsLatin}]+", ""))
    return let(F.filter(T.language_words(text), lambda w: w.isin(*known)), told) & let(letters, lambda n: (n == 0) | (latin >= 0.7 * n))


def base_verb(verb: Column) -> Column:
    """The base form of a verb of finished work."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _bases().items() for x in pair)), F.lower(verb)), F.lower(verb))


def _bases() -> dict[str, str]:
    regular = {v: next((w for w in WORK if w in (v[:-2], v[:-1], v[:-3])), v[:-2]) for v in DONE if v.endswith("ed")}
    return regular | BASE


def clause_subject(words: Column) -> Column:
    """The noun phrase that ends where the verb begins: what follows the last word that cannot be in one."""

    def after(own: Column) -> Column:
        stop = F.array_max(F.transform(own, lambda w, i: F.when(F.lower(w).isin(STOPS), i + 1).otherwise(0)))
        return F.array_join(F.slice(own, stop + 1, F.size(own)), " ")

    return let(F.filter(F.split(words, " "), lambda w: w != ""), after)


def tidy(label: Column) -> Column:
    """Without articles in front, what only links on behind, and outer punctuation."""
    out = F.regexp_replace(F.trim(F.regexp_replace(label, r"\s+", " ")), r"(?i)^(?:the|a|an|our|my|to) ", "")
    out = F.regexp_replace(out, rf"(?i)\s+(?:as|{LINKS})\b.*$", "")
    return F.regexp_replace(out, r"^[\s\"'`*_(\[]+|[\s\"'`*_.,;:!?)\]]+$", "")


def _pass(number: int) -> str:
    """What one pass finds in ``masked``, as SQL: one expression is built faster than its parts one by one."""
    kind, pattern, group, other = PASSES[number]
    value = lambda k: f'regexp_extract(h.text, r"{pattern}", {k})' if k else "''"
    found = f"""aggregate(filter(zip_with(split(masked, r"{pattern}", -1), regexp_extract_all(masked, r"{pattern}", 0), (b, f) -> named_struct('gap', length(b), 'text', f)), p -> p.text IS NOT NULL),
      named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,stop:int,text:string>>)),
      (acc, p) -> named_struct('at', acc.at + p.gap + length(p.text), 'out', concat(acc.out, array(named_struct('start', acc.at + p.gap, 'stop', acc.at + p.gap + length(p.text), 'text', p.text)))), acc -> acc.out)"""
    rows = f"transform({found}, h -> named_struct('pass', {number}, 'start', h.start, 'stop', h.stop, 'kind', '{kind}', 'label', {value(group)}, 'other', {value(other)}))"
    early = "role = 'user' AND turn < 4 AND " if kind == "goal" else ""
    # Most passes find nothing in a message: one look is cheaper than taking it apart. Subjects are walked from every word, so
    # the look is for what follows them.
    look = pattern.replace(rf"\b{SUBJECT}", "")
    return f'CASE WHEN {early}masked RLIKE r"{look}" THEN {rows} ELSE cast(array() AS {SCHEMA}) END'


def candidates() -> Column:
    """Of a row with ``masked``, ``role`` and ``turn``."""
    return F.expr(f"flatten(array({', '.join(map(_pass, range(len(PASSES))))}))")


def claimed(candidates: Column) -> Column:
    """Of candidates those that overlap none taken before them, by pass and place."""

    def step(acc: Column, c: Column) -> Column:
        free = ~F.exists(acc, lambda t: (c["start"] < t["stop"]) & (t["start"] < c["stop"]))
        return F.when(free, F.concat(acc, F.array(c))).otherwise(acc)

    return F.aggregate(F.array_sort(candidates), F.array().cast(SCHEMA), step)


def _judged(masked: Column, c: Column, role: Column) -> Column:
    """A candidate with its kind after a look at its clause; kind null where it makes no fact."""
    # A clause begins where none goes on: tried from each of its places, its end would be looked for again and again.
    lead = F.regexp_extract(F.substring(masked, F.greatest(c["start"] - 160, F.lit(0)) + 1, F.least(c["start"], F.lit(160))), r"(?<![^.!?;\n])([^.!?;\n]*)$", 1)
    tail = F.regexp_extract(masked.substr(c["stop"] + 1, F.lit(240)), r"^([^.!?\n]*[.!?]?)", 1)
    hit = masked.substr(c["start"] + 1, c["stop"] - c["start"])
    return let(F.struct(lead.alias("lead"), tail.alias("tail"), hit.alias("hit")), lambda around: _weighed(around, c, role))


def _weighed(around: Column, c: Column, role: Column) -> Column:
    lead, tail, hit = around["lead"], around["tail"], around["hit"]
    kind, question = c["kind"], tail.endswith("?")
    heading = c["pass"].isin([n for n, (_, pattern, *_) in enumerate(PASSES) if "(?im)^" in pattern])
    off = lead.rlike(NEGATED) | lead.rlike(CONDITION) | hit.rlike(CONDITION) | (kind.isin("task_done", "error") & hit.rlike(INNER_NEGATION))
    doubt = lead.rlike(DOUBT) | question
    wish = kind.isin("decision", "proposal", "change") & (doubt | (kind == "proposal"))
    sound = F.when(heading, kind).when(off, None).when(wish, F.when(role == "user", "proposal")).when(kind.isin("task_done", "task_todo", "task_wip", "error") & question, None)
    sound = sound.when(kind.isin("task_done",) & lead.rlike(DOUBT), None).otherwise(kind)
    passive = (kind == "task_done") & (c["pass"] == len(PASSES) - 3)
    subject = passive | (c["pass"] == len(PASSES) - 2)
    plain = F.when(subject, clause_subject(c["label"])).otherwise(c["label"])
    verb = F.when((kind == "task_done") & (c["other"] != ""), F.concat(F.initcap(base_verb(c["other"])), F.lit(" "))).otherwise("")
    old = F.when(kind == "change", c["other"]).otherwise("")

    def said(v: Column) -> Column:
        label = F.when(kind == "change", F.concat(F.lit("Use "), c["label"])).otherwise(F.concat(verb, v["body"]))
        good = F.length(F.when(kind == "change", c["label"]).otherwise(v["body"])) >= 2
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.when(good, F.when(v["sound"] == "change", "decision").otherwise(v["sound"])).alias("kind"), label.alias("label"), old.alias("old"))

    return let(F.struct(sound.alias("sound"), tidy(plain).alias("body")), said)


def message_facts(messages: DataFrame) -> DataFrame:
    """``(session_id, turn, kind, label, old, start, stop)`` of every message, proposals included; places count from 0."""
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    prose = (role != "tool") & looks_english(text)
    m = messages.select("session_id", "turn", role, text.alias("text")).withColumn("masked", F.when(prose, mask(text)).otherwise(""))
    none = F.array().cast(SCHEMA)
    m = m.withColumn("taken", F.when(F.col("masked").rlike("[a-z]"), claimed(candidates())).otherwise(none))
    said = F.transform("taken", lambda c: _judged(F.col("masked"), c, role))

    def formed(kind: str) -> Column:
        own = finds(F.col("text"), extract.PATTERNS[kind])
        return F.transform(own, lambda f: F.struct(f["start"].alias("start"), f["stop"].alias("stop"), F.lit(kind).alias("kind"), F.regexp_extract(f["text"], extract.PATTERNS[kind], 1).alias("label"), F.lit("").alias("old")))

    forms = [F.when(F.col("text").rlike(extract.NEEDS[k]), formed(k)).otherwise(F.array().cast("array<struct<start:int,stop:int,kind:string,label:string,old:string>>")) for k in KINDS_OF_FORM]
    rows = m.select("session_id", "turn", "role", F.explode(F.concat(said, *forms)).alias("f")).filter("f.kind IS NOT NULL AND f.label <> ''")
    return rows.select("session_id", "turn", "f.kind", "f.label", "f.old", "f.start", "f.stop")


def accepted(messages: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with each proposal that the next turn accepts as a decision of its turn; the others go."""
    by = W.partitionBy("session_id").orderBy("turn")
    turns = messages.filter("role <> 'system'").select("session_id", "turn", F.lead("role").over(by).alias("next_role"), F.lead("text").over(by).alias("reply"))
    first = F.regexp_extract("reply", r"^([^.!?\n]*)", 1)
    yes = turns.filter((F.col("next_role") == "assistant") & F.col("reply").rlike(YES) & ~first.rlike(NO)).select("session_id", "turn")
    proposals = found.filter("kind = 'proposal'").join(yes, ["session_id", "turn"], "left_semi").withColumn("kind", F.lit("decision"))
    return found.filter("kind <> 'proposal'").unionByName(proposals)


def normal(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}./_-]+", " "), 1, 80)


def parts(spark: SparkSession, rows: int) -> int:
    """As many as the rows ask for: facts are short and costly, so by their bytes Spark would leave all to one task or two."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PER_PART))


def conversation_facts(messages: DataFrame) -> DataFrame:
    """``(session_id, kind, label, old, first_turn, n)``: the facts of every session, each once, at its first place.

    What messages give is settled first, in the shared folder: it is looked at several times, the texts only once.
    """
    given = settled(message_facts(messages))
    found = accepted(messages, given).withColumn("norm", normal(F.col("label")))
    place = F.struct("turn", "start")
    found = found.repartition(parts(messages.sparkSession, given.count()), "session_id")
    one = settled(found.groupBy("session_id", "kind", "norm").agg(F.min_by("label", place).alias("label"), F.min_by("old", place).alias("old"), F.min("turn").alias("first_turn"), F.count("*").alias("n")))
    done = one.filter("kind = 'task_done'").select("session_id", "norm").distinct()
    open_ = one.filter("kind IN ('task_todo', 'task_wip')").join(done, ["session_id", "norm"], "left_anti")
    kept = one.filter("kind NOT IN ('task_todo', 'task_wip')").unionByName(open_).drop("norm")
    return drop_vaguer(extract.drop_shadowed_paths(kept))


def drop_vaguer(found: DataFrame) -> DataFrame:
    """Decisions of a session whose words another decision of it all has, with more beside, go.

    A subset has its rarest word in common with whatever holds it, so each decision is looked up by that word alone.
    """
    own = found.filter("kind = 'decision'").select("session_id", "label", T.words(F.col("label"), 2).alias("words")).distinct()
    each = own.select("session_id", "label", "words", F.explode("words").alias("word"))
    df = each.groupBy("session_id", "word").agg(F.count("*").alias("df"))
    rarest = each.join(df, ["session_id", "word"]).groupBy("session_id", "label").agg(F.min_by("word", F.struct("df", "word")).alias("word"), F.first("words").alias("words"))
    larger = each.select("session_id", "word", F.col("words").alias("more"), F.col("label").alias("by"))
    gone = rarest.join(larger, ["session_id", "word"]).filter((F.size("more") > F.size("words")) & (F.size(F.array_except("words", "more")) == 0)).select("session_id", "label").distinct()
    rest = found.filter("kind = 'decision'").join(gone, ["session_id", "label"], "left_anti")
    return found.filter("kind <> 'decision'").unionByName(rest)
