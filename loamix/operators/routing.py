"""What an answering agent does with a question before and after its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U
from loamix.operators import agents as A
from loamix.operators import pages as P
from loamix.operators import retrieval as R

#: Questions for a place or a contact, which are searched as they are.
PLACE_WORDS = (
    "address", "location", "located", "where is", "where's", "postal", "mailing", "map", "directions", "how to reach", "how do i reach", "email",
    "phone number", "contact number", "contact detail", "contact info", "zip", "pincode", "post code",
)
#: Questions of the general route.
COUNT_DEPARTMENTS = ("how many department", "list department", "all department", "department names", "departments in", "how many dept", "what departments")
LIST_DEPARTMENTS = ("all departments name", "departments name", "tell me all department", "list departments", "how many department", "name all department")
NEWS_WORDS = ("news", "latest", "recent", "events", "happening", "updates", "activities", "announcement")
NEWS_QUERY = "university recent activities events sessions programs"
#: Agents for the parts of a question, in this order; words for attendance, and those that ask for another rule.
AGENTS = {
    "faculty": ("who is", "hod", "head of", "dean", "registrar", "vc", "vice chancellor", "contact", "email", "phone", "teacher", "lecturer", "professor", "treasurer", "pro vc", "pro-vc"),
    "policy": (
        "attendance", "cgpa", "policy", "rule", "regulation", "absent", "freeze", "probation", "punishment", "plagiar", "discipline", "conduct", "harassment",
        "grading", "grade", "gpa", "exam", "cheating", "sexual", "misconduct",
    ),
    "admissions": ("admission", "apply", "eligibility", "merit", "program", "undergraduate", "graduate", "documents"),
    "fees": ("fee", "fees", "scholarship", "tuition", "challan"),
    "campus": ("library", "bus", "transport", "hostel", "location", "located", "address", "where is", "where's"),
}
ATTENDANCE = ("attendance", "attandance", "attendence", "atandance", "absent", "miss class", "haazri", "75", "percent", "ghair haazir", "present in class")
OTHER_RULES = ("harassment", "grading", "grade", "cgpa", "discipline", "plagiar", "conduct", "policy")
LONGEST_REWRITE = 12
SHORTEST_CHUNK, LONGEST_PROMPT = 50, 2000
EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,relation:string,target:string>>"


def agent_of(part: Column) -> Column:
    """The agent for one part of a question that asks for several things: the first whose words it holds."""
    low = F.lower(part)
    return F.coalesce(*[F.when(P.any_of(words, low), F.lit(agent)) for agent, words in AGENTS.items()], F.lit("general"))


def searches_all(part: Column) -> Column:
    """Whether a question on rules is searched for in all categories: one on attendance alone."""
    low = F.lower(part)
    return P.any_of(ATTENDANCE, low) & ~P.any_of(OTHER_RULES, low)


def merged_parts(found: DataFrame, content: str = "content") -> DataFrame:
    """query_id, chunk_id, new_rank of what the parts of a question found (query_id, part, rank, chunk_id): part by part, each content once."""
    first = Window.partitionBy("query_id", F.sha2(F.coalesce(T.content_key(F.col(content)), F.lit("")), 256)).orderBy("part", "rank", "chunk_id")
    once = found.withColumn("copy_", F.row_number().over(first)).filter("copy_ = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "chunk_id"))
    return once.select("query_id", "chunk_id", place.cast("bigint").alias("new_rank"))


def campus_query(query: Column, rewrite: Column) -> Column:
    """What is searched for: the question itself if it asks for a place or contact, or if its rewrite is empty or long."""
    new = F.regexp_replace(F.coalesce(rewrite, F.lit("")), r"^\s+|\s+$", "")
    bad = (new == "") | (F.size(F.split(new, r"\s+")) > LONGEST_REWRITE)
    return F.when(P.any_of(PLACE_WORDS, F.lower(query)) | bad, query).otherwise(new)


def quality(best: Column, n: Column) -> Column:
    """Grade of what was found, by its best score; found rows without scores are good."""
    return F.when(n == 0, "empty").when(best.isNull() | (best > 0.5), "good").when(best > 0, "partial").otherwise("poor")


def retried(queries: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (query_id, ...) of the first search, and of the second for questions whose first was empty or poor (score)."""
    told = first.groupBy("query_id").agg(F.max("score").alias("best_"), F.count("*").alias("n_"))
    graded = queries.select("query_id").distinct().join(told, "query_id", "left").select("query_id", quality(F.col("best_"), F.coalesce("n_", F.lit(0))).alias("grade_"))
    failed = graded.filter(F.col("grade_").isin("empty", "poor")).select("query_id")
    return first.join(failed, "query_id", "left_anti").unionByName(second.join(failed, "query_id", "left_semi"))


def general_branch(query: Column) -> Column:
    """Struct of the branches of the general route in the order they are tried, and of what the last one searches for."""
    low = F.lower(query)
    tried = F.array(
        F.when(F.size(A.asked_populations(query)) > 0, F.lit("populations")), F.when(P.any_of(COUNT_DEPARTMENTS, low), F.lit("departments")),
        F.when(P.any_of(LIST_DEPARTMENTS, low), F.lit("department list")), F.lit("search"),
    )
    search = F.when(P.any_of(NEWS_WORDS, low), F.lit(NEWS_QUERY)).otherwise(query)
    return F.struct(F.filter(tried, lambda b: b.isNotNull()).alias("branches"), search.alias("search"))


def first_filled(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found (query_id, branch, ...) of each question's first branch, in its order (query_id, branches), that has any."""
    order = queries.select("query_id", F.posexplode("branches").alias("at_", "branch"))
    rows = found.join(order, ["query_id", "branch"])
    first = rows.groupBy("query_id").agg(F.min("at_").alias("at_"))
    return rows.join(first, ["query_id", "at_"]).select(*found.columns)


def faculty_order(rows: DataFrame, value: Column, is_furniture: Column, most: int = 10) -> DataFrame:
    """query_id, chunk_id, new_rank of rows (query_id, chunk_id, rank, score, content): each content once, then by value where the
    scores say nothing (at most one distinct score among 2 to `most` rows), else furniture last in the order found."""
    per = Window.partitionBy("query_id", "content").orderBy("rank", "chunk_id")
    once = rows.withColumn("value_", value).withColumn("f_", is_furniture).withColumn("copy_", F.row_number().over(per)).filter("copy_ = 1")
    told = once.groupBy("query_id").agg(F.count("*").alias("n_"), F.count_distinct("score").alias("scores_"), F.count_if("f_").alias("late_"))
    mute = (F.col("scores_") <= 1) & F.col("n_").between(2, most)
    sink = (F.col("late_") > 0) & (F.col("late_") < F.col("n_")) & F.col("f_")
    first, then = F.when(mute, -F.round("value_", 6)).otherwise(sink.cast("double")), F.when(~mute, F.col("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_", "then_", "chunk_id"))
    ready = once.join(told, "query_id").withColumn("first_", first).withColumn("then_", then)
    return ready.select("query_id", "chunk_id", place.cast("bigint").alias("new_rank"))


def from_sources(chunks: DataFrame, pages: DataFrame, source: str = "source") -> DataFrame:
    """Chunks whose source has the path of one of the pages (url)."""
    wanted = pages.select(U.path(F.col("url")).alias("route_")).distinct()
    return chunks.withColumn("route_", U.path(F.col(source))).join(wanted, "route_", "left_semi").select(*chunks.columns)


def tool_search(ranked: DataFrame, wanted: Column, most: int, top: int) -> DataFrame:
    """The first `top` of a question's first `most` rows that are wanted, ranked anew."""
    rows = ranked.filter(F.col("rank") <= most).filter(wanted).withColumnRenamed("rank", "found_rank")
    return R.ranked(rows, [F.col("found_rank")], top).drop("found_rank")


def answer_of(reply: Column) -> Column:
    """What stands behind the first ANSWER: of a reply; else all of it."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.contains(reply, F.lit("ANSWER:")), bare(F.regexp_replace(reply, r"(?s)^.*?ANSWER:", ""))).otherwise(bare(reply))


def head_line(person: Column, department: Column, description: Column) -> Column:
    """A line on who heads a department, with the last mail of the description, else with its start."""
    mails = F.filter(F.split(F.coalesce(description, F.lit("")), r"\s+"), lambda w: F.contains(w, F.lit("@")))
    mail = F.regexp_replace(F.try_element_at(mails, F.lit(-1)), r"^[.,;()]+|[.,;()]+$", "")
    more = F.coalesce(F.when(mail != "", mail), F.when(description != "", F.substring(description, 1, 60)))
    return F.concat(F.lit("• "), department, F.lit(": "), person, F.coalesce(F.concat(F.lit(" — "), more), F.lit("")))


def extraction_prompt(text: Column) -> Column:
    """The part of a chunk that the extractor is given; null for chunks too short to ask about."""
    return F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) >= SHORTEST_CHUNK, F.substring(text, 1, LONGEST_PROMPT))


def extraction_of(reply: Column) -> Column:
    """Struct of entities and relationships of a JSON reply, in a code fence or not; both empty if it can't be read."""
    parts = F.transform(F.split(reply, "```"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"^json\s*", ""))
    fenced = F.get(F.filter(parts, lambda p: p.startswith("{")), F.lit(0))
    read = F.from_json(F.coalesce(fenced, reply), EXTRACTION)
    kinds = dict(e=("entities", "array<struct<name:string,type:string,description:string>>"), r=("relationships", "array<struct<source:string,relation:string,target:string>>"))
    return F.struct(*[F.coalesce(read[name], F.array().cast(kind)).alias(name) for name, kind in kinds.values()])


def unextracted(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that an earlier run hasn't extracted yet."""
    return chunks.join(done.select(key).distinct(), key, "left_anti").select(*chunks.columns)
