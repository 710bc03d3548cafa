"""Conversation windows, follow-ups, small talk and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a question that leans on the one before it.
REFERENT = r"(?i)\b(it|it's|its|they|them|their|theirs|he|him|his|she|her|hers)\b"
DEMONSTRATIVE = r"(?i)\b(this|that|these|those|there)\b\s*(?:[?.!,]|$|(?:is|are|was|were|do|does|did|mean|means|work|works)\b)"
FRAGMENT = (
    r"(?i)^\s*(?:(?:and|also|what about|how about|more|tell me more|explain|elaborate|details?|in detail|not in|in table|as table|as a table|in a table"
    r"|give me more|continue|go on|same|ok now)\b|(?:why|how|when|where|who|which|what)\s*(?:not|else|so)?\s*[?.!]*\s*$)"
)
ANY_DEMONSTRATIVE = r"(?i)\b(this|that|these|those|there)\b"
SHORT, MOST = 30, 90
#: Small talk. Greetings and farewells are whole words, all others parts of the message.
GREETINGS = ("hello", "hi", "hey", "salam", "assalam", "good morning", "good evening", "good afternoon")
THANKS = ("thank", "thanks", "shukriya", "jazakallah", "شکریہ")
FAREWELLS = ("bye", "goodbye", "allah hafiz", "khuda hafiz")
ABOUT_BOT = ("who are you", "what is your name", "your name", "how are you", "kaisa ho")
OTHER_TOPICS = (
    "what is 2+2", "what is 2 + 2", "what is 1+1", "what is 1 + 1", "2+2", "2 + 2", "1+1", "times 7", "times 5", "times 3", "divided by", "multiply", "solve this",
    "what is the answer to", "who invented", "history of the world", "population of", "currency of", "capital of pakistan", "capital of india", "tell me a joke",
    "write a poem", "sing a song", "calculate", "what is the weather", "what time is it", "what is today", "translate", "capital of", "what is the meaning of",
)
PERSONAL = ("my name is", "i am in", "i study", "i'm in", "i am a student", "call me")
MEMORY = (
    "what did i", "do you remember", "i told you", "as i said", "i mentioned", "what did i tell", "what is my name", "my name", "what am i", "who am i",
    "what year am i", "what type of student", "what kind of student", "which university am i", "what did i say", "summarize", "summary of", "what have i asked",
    "what did we discuss", "recap",
)
PARTS = THANKS + ABOUT_BOT + PERSONAL + MEMORY + OTHER_TOPICS
#: How questions are taken apart.
INTENT_CUT = r"(?i)\s*,\s+and\s+|\s*,\s*|\s+and\s+|\s*;\s*|\s*&\s*"
QUESTION = r"(?i)^(who\s+is|who\s+are|what\s+is|what\s+are|where\s+is|where\s+are|when\s+is|when\s+are|how\s+is|how\s+are|tell\s+me\s+about|tell\s+me)\b"
INTENT_STOP = (
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "to", "in", "on", "at", "for", "from", "by", "with", "do", "does", "did", "can", "could", "will",
    "would", "should", "i", "me", "my", "we", "our", "you", "your", "it", "its", "there", "that", "this", "and", "or", "what", "which", "how", "many", "much",
    "please", "tell", "give", "about",
)
#: Keyword families of the router, in order.
HIERARCHY = (
    "report to whom", "report to who", "who report", "chain of command", "who manages", "who oversees", "who is above", "who is below", "management structure",
    "org structure", "organizational", "hierarchy", "accountable to", "who controls", "governance structure", "who is in charge of", "who heads",
)
HARASSMENT = ("how do i report", "how to report harassment", "how can i report", "complaint procedure", "file a complaint", "report harassment", "sexual harassment complaint")
FAMILIES = {
    "faculty": ("who is", "who's", "vice chancellor", "vice-chancellor", "pro vc", "pro-vc", "registrar", "treasurer", "controller of examination", "hod", "head of the", "head of department", "dean", "chairman", "email", "phone", "extension", "contact"),
    "policy": ("attendance", "cgpa", "freeze", "probation", "promotion", "supplementary", "re-appear", "reappear", "plagiar", "disciplinary", "discipline", "conduct rules", "withdraw", "grading"),
    "admissions": ("admission", "admitted", "apply", "application", "eligibility", "entry requirement", "merit", "documents", "how long is"),
    "fees": ("fee", "fees", "scholarship", "financial aid", "stipend", "tuition", "challan", "cost of"),
    "campus": ("library", "bus", "transport", "hostel", "cafeteria", "canteen", "sports", "gym", "laboratory", "facilities", "wifi", "wi-fi", "medical", "mosque", "timings", "address", "located", "location"),
}


def any_part(words: tuple[str, ...], text: Column) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(text, F.lit(w))
    return hit


def last_turns(turns: DataFrame, keep: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last `keep` messages of each conversation."""
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))
    return turns.withColumn("back", back).filter(F.col("back") <= keep).drop("back")


def to_summarise(turns: DataFrame, above: int = 10, keep: int = 6, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages that go into the summary: all but the last `keep` of conversations of more than `above`."""
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))
    n = F.count("*").over(Window.partitionBy(conv))
    return turns.withColumn("back", back).withColumn("n", n).filter((F.col("n") > above) & (F.col("back") > keep)).drop("back", "n")


def follow_ups(turns: DataFrame, human: str = "user", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Human turns with `resolved`: a short one that leans on the last human turn names it."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    said = F.trim("text")
    previous = F.last(F.when((F.col("role") == human) & (said != ""), said), ignorenulls=True).over(before)
    rows = turns.withColumn("said", said).withColumn("previous", previous).filter(F.col("role") == human)
    text = F.col("said")
    leans = text.rlike(REFERENT) | text.rlike(DEMONSTRATIVE) | text.rlike(FRAGMENT) | ((F.length(text) <= SHORT) & text.rlike(ANY_DEMONSTRATIVE))
    applies = (text != "") & (F.length(text) <= MOST) & F.col("previous").isNotNull() & leans & ~F.contains(F.lower(text), F.lower("previous"))
    named = F.concat(text, F.lit(" (in the context of: "), F.substring("previous", 1, 120), F.lit(")"))
    return rows.withColumn("resolved", F.when(applies, named).otherwise(F.col("text"))).drop("said", "previous")


def is_small_talk(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    words = F.split(low, r"\s+")
    return (low == "") | F.arrays_overlap(words, F.array(*[F.lit(w) for w in (*GREETINGS, *FAREWELLS)])) | any_part(PARTS, low)


def route(text: Column, classified: Column | None = None) -> Column:
    """Ordered rules; exactly one keyword family decides, else the classifier's word, else general."""
    low = F.lower(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    gibberish = (F.length(text) > 2) & (plain < 0.5 * F.length(text))
    mail = F.regexp_replace(low, "e-?mail address", "email")
    hits = F.filter(F.array(*[F.when(any_part(words, mail), F.lit(name)) for name, words in FAMILIES.items()]), lambda x: x.isNotNull())
    return (
        F.when(any_part(HIERARCHY, low), "general")
        .when(low.rlike(r"\d+\s*[-+*/]\s*\d+") | gibberish, "out_of_scope")
        .when(any_part(HARASSMENT, low), "policy")
        .when(low.rlike("re-?admission"), "policy")
        .when(any_part(("tell me about", "tell about"), low) & ~any_part(("cricket", "flight", "weather", "world cup", "politics", "movie", "song"), low), "faculty")
        .when(F.size(hits) == 1, F.get(hits, F.lit(0)))
        .otherwise(F.coalesce(classified, F.lit("general")) if classified is not None else F.lit("general"))
    )


def sub_questions(text: Column) -> Column:
    """Parts of a question that asks for several things; none if it asks for one.

    A part without a question word takes over the last one before it. Without any
    at the start, only parts with three content words count; else one is enough.
    Two parts must be left.
    """
    parts = F.filter(F.transform(F.split(text, INTENT_CUT), lambda x: F.regexp_replace(x, "^[ ?.,]+|[ ?.,]+$", "")), lambda x: x != "")
    prefix = lambda x: F.regexp_extract(x, QUESTION, 1)
    asks = prefix(F.trim(text))

    def content(part: Column) -> Column:
        found = F.regexp_extract_all(F.lower(part), F.lit("[a-z0-9']+"), F.lit(0))
        return F.size(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*INTENT_STOP)))

    def take(done: Column, part: Column) -> Column:
        own = prefix(part)
        last = F.when(own != "", own).otherwise(done["last"])
        whole = F.when(own != "", part).otherwise(F.concat(last, F.lit(" "), part))
        return F.struct(last.alias("last"), F.concat(done["parts"], F.array(whole)).alias("parts"))

    start = F.struct(asks.alias("last"), F.array().cast("array<string>").alias("parts"))
    led = F.aggregate(parts, start, take, lambda done: done["parts"])
    found = F.when(asks != "", F.filter(led, lambda p: content(p) >= 1)).otherwise(F.filter(parts, lambda p: content(p) >= 3))
    return F.when((F.size(parts) > 1) & (F.size(found) > 1), found).otherwise(F.array().cast("array<string>"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", minutes: int = 30) -> DataFrame:
    """user, session_no, started, ended, n: a session ends when nothing happens for that long."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    gap = F.col(ts) - F.lag(ts).over(w) > F.make_dt_interval(mins=F.lit(minutes))
    no = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w)
    return events.withColumn("session_no", no.cast("bigint")).groupBy(user, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
