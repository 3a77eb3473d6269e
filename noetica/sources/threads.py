"""Raw threads: marked turns, and search threads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noetica.functions.text import strip

# Turn markers, the steps of a search thread, least and most characters of its query and
# answer, least of a plain text, most of a label.
USER, ASSISTANT = "[User]:", "[Assistant]:"
QUERY_STEP, FINAL_STEP = "INITIAL_QUERY", "FINAL"
LEAST_QUERY, QUERY_CAP, LEAST_ANSWER, ANSWER_CAP, LEAST_PLAIN, LABEL_CAP = 10, 2000, 50, 3000, 100, 60


def split_turns(threads: DataFrame, raw: str = "raw_content") -> DataFrame:
    """A row (.., turn, role, content) per turn of each thread; text before the first marker is left out.

    One split before every line that starts with a marker: no shuffle and no window.
    """
    parts = F.filter(F.split(F.col(raw), r"(?md)^(?=\[User\]:|\[Assistant\]:)"), lambda p: p.startswith(USER) | p.startswith(ASSISTANT))
    rest = [c for c in threads.columns if c != raw]
    rows = threads.select(*rest, F.posexplode(parts).alias("turn", "part"))
    user = F.col("part").startswith(USER)
    after = F.when(user, F.substring("part", len(USER) + 1, 1 << 30)).otherwise(F.substring("part", len(ASSISTANT) + 1, 1 << 30))
    lines = F.transform(F.split(after, "\n"), lambda x, i: F.when(i == 0, strip(x)).otherwise(x))
    return rows.select(*rest, "turn", F.when(user, "user").otherwise("assistant").alias("role"), strip(F.array_join(lines, "\n")).alias("content"))


def balanced(text: Column) -> Column:
    """The text up to where its square brackets first balance after the first character, wherever they stand; whole if they don't."""
    step = lambda s, c: F.struct((s["depth"] + (c == "[").cast("int") - (c == "]").cast("int")).alias("depth"), (s["at"] + 1).alias("at"), s["end"].alias("end"))
    close = lambda s: F.struct(s["depth"].alias("depth"), s["at"].alias("at"), F.when((s["end"] == 0) & (s["depth"] == 0) & (s["at"] > 1), s["at"]).otherwise(s["end"]).alias("end"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(text, ""), start, lambda s, c: close(step(s, c)))["end"]
    return F.when(end > 0, F.substring(text, F.lit(1), end)).otherwise(text)


def extract_searches(threads: DataFrame, strict: bool = False) -> DataFrame:
    """(label, name, body, turn_index) of search threads (label, raw_content): a query and an answer, the last final step's.

    The steps are the first JSON value of the text, an array or one step alone; what follows it is left out. An answer may be
    JSON that holds the answer. A text that is no such JSON is an episode itself if it is long enough. strict cuts the text
    where its brackets balance first, in strings too.
    """
    raw = F.coalesce("raw_content", F.lit(""))
    text = F.when(raw.startswith(ASSISTANT), strip(F.substring(raw, len(ASSISTANT) + 1, 1 << 30))).otherwise(raw)
    rows = threads.select(F.coalesce("label", F.lit("")).alias("label"), (balanced(text) if strict else text).alias("text"))
    # the steps' contents stay text until it is known which are wanted
    steps = rows.withColumn("steps", F.from_json("text", "array<struct<step_type: string, content: string>>"))
    content = lambda kind, field: F.try_element_at(F.filter(F.transform(F.filter("steps", lambda x: x["step_type"] == kind), lambda x: F.get_json_object(x["content"], f"$.{field}")), lambda c: c.isNotNull()), F.lit(-1))
    read = steps.select("label", "text", F.col("steps").isNull().alias("plain"), content(QUERY_STEP, "query").alias("query"), content(FINAL_STEP, "answer").alias("told"))
    answer = F.coalesce(F.get_json_object("told", "$.answer"), F.col("told"))
    episode = lambda name, body, place: F.struct(name.alias("name"), body.alias("body"), F.lit(place).alias("turn_index"))
    found = F.array(
        F.when(F.col("plain") & (F.length("text") > LEAST_PLAIN), episode(F.substring("label", 1, LABEL_CAP), F.substring("text", 1, ANSWER_CAP), 0)),
        F.when(F.length("query") > LEAST_QUERY, episode(F.lit("Query"), F.concat(F.lit("user: "), F.substring("query", 1, QUERY_CAP)), 0)),
        F.when(F.length(answer) > LEAST_ANSWER, episode(F.lit("Answer"), F.concat(F.lit("assistant: "), F.substring(answer, 1, ANSWER_CAP)), 1)),
    )
    return read.select("label", F.inline(F.array_compact(found)))
