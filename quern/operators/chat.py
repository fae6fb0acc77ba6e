"""Instruction, chat and preference rows in the shapes that training takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# The instruction templates.
WITH_INPUT = "Below is an instruction that describes a task, paired with an input. Write a response that appropriately completes the request.\n\n### Instruction:\n{}\n\n### Input:\n{}\n\n### Response:\n"
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{}\n\n### Response:\n"


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", parts.alias("p")))), lambda x: x["p"]), "")


def chatml_message() -> Column:
    return F.concat(F.lit(START), "role", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))


def chatml(turns: DataFrame, generation: bool = False) -> DataFrame:
    """``conv_id``, ``text``: the turns in order; with ``generation`` an open assistant turn follows."""
    out = turns.groupBy("conv_id").agg(_joined(chatml_message()).alias("text"))
    return out.withColumn("text", F.concat("text", F.lit(f"{START}assistant\n"))) if generation else out


def assistant_spans(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``start``, ``end`` of each assistant text inside its conversation's ChatML text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length(chatml_message())).over(before), F.lit(0))
    start = (offset + len(START) + F.char_length("role") + 1).cast("long")
    rows = turns.withColumn("start", start).where("role = 'assistant'")
    return rows.select("conv_id", "turn", "start", (F.col("start") + F.char_length(F.coalesce("text", F.lit("")))).alias("end"))


def llama(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``text``: user turns in instruction marks with the answer that follows; a leading system turn goes into
    the first user turn; answers without a question are dropped."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("n", F.row_number().over(over)).withColumn("system", F.max(F.when((F.col("n") == 1) & (F.col("role") == "system"), F.col("text"))).over(Window.partitionBy("conv_id")))
    rows = rows.withColumns({"next_role": F.lead("role").over(over), "next_text": F.lead("text").over(over)}).where("role = 'user'")
    rows = rows.withColumn("u", F.row_number().over(over))
    asked = F.when((F.col("u") == 1) & (F.coalesce("system", F.lit("")) != ""), F.concat(F.lit("<<SYS>>\n"), "system", F.lit("\n<</SYS>>\n\n"), "text")).otherwise(F.col("text"))
    answer = F.when(F.col("next_role") == "assistant", F.concat(F.lit(" "), F.coalesce("next_text", F.lit("")), F.lit(" </s>\n"))).otherwise(" ")
    texts = rows.groupBy("conv_id").agg(_joined(F.concat(F.lit("<s>[INST] "), asked, F.lit(" [/INST]"), answer)).alias("text"))
    return turns.select("conv_id").distinct().join(texts, "conv_id", "left").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))


def llama_spans(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``n``, ``start``, ``end`` of the answers between '[/INST] ' and ' </s>' in the formatted texts."""
    mark, stop = "[/INST] ", " </s>"
    parts = F.split("text", r"\Q" + mark + r"\E", -1)
    rows = formatted.select("conv_id", F.posexplode(parts).alias("n", "part"))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum(F.char_length("part") + len(mark)).over(upto)
    rows = rows.withColumn("start", start.cast("long")).where(F.col("n") > 0).where(F.col("part").contains(stop))
    return rows.select("conv_id", "n", "start", (F.col("start") + F.instr("part", stop) - 1).cast("long").alias("end"))


def alpaca(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``text``, ``start``, ``end``: the last user and assistant turns in the instruction template, and where
    the response stands."""
    last = lambda role: F.coalesce(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    rows = turns.groupBy("conv_id").agg(last("user").alias("i"), last("input").alias("x"), last("assistant").alias("r"))
    fill = lambda t, *c: F.concat(*[p for a, b in zip((F.lit(s) for s in t.split("{}")), (*c, F.lit("")), strict=True) for p in (a, b)])
    prompt = F.when(F.col("x") != "", fill(WITH_INPUT, F.col("i"), F.col("x"))).otherwise(fill(WITHOUT_INPUT, F.col("i")))
    rows = rows.withColumn("prompt", prompt).withColumn("text", F.concat("prompt", "r"))
    return rows.select("conv_id", "text", F.char_length("prompt").cast("long").alias("start"), F.char_length("text").cast("long").alias("end"))


def instruct_prompt(instruction: Column, extra: Column) -> Column:
    """The plain template: the input section only where there is one."""
    middle = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("### Input:\n"), extra, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n"), middle, F.lit("### Response:\n"))


def token_labels(ids: Column, text_length: Column, spans: Column) -> Column:
    """Labels of ids: the id where its average character range meets a span (struct of start, end), else -100."""
    width = text_length / F.size(ids)
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (F.floor(i * width) < s["end"]) & (F.floor((i + 1) * width) > s["start"])), x).otherwise(-100))


def char_ids(text: Column) -> Column:
    """Code points modulo 256: the fallback encoding."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.pmod(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"), F.lit(256)).cast("int"))


def encode_pair(prompt: Column, response: Column, max_length: int = 512, max_prompt: int = 256, pad: bool = True) -> Column:
    """Struct of ``input_ids``, ``labels`` (-100 on the prompt and padding) and ``attention_mask``."""
    p = F.slice(prompt, 1, max_prompt)
    r = F.slice(response, 1, F.lit(max_length) - F.size(p))
    fill = F.greatest(F.lit(0), F.lit(max_length) - F.size(p) - F.size(r)) if pad else F.lit(0)
    n = F.size(p) + F.size(r)
    return F.struct(
        F.concat(p, r, F.array_repeat(F.lit(0), fill)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(-100), F.size(p)), r, F.array_repeat(F.lit(-100), fill)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
    )


def feedback_examples(rows: DataFrame, prompt: str = "prompt", response: str = "response", desirable: str = "is_desirable", max_length: int = 512, max_prompt: int = 256) -> DataFrame:
    """Binary feedback: ``input_ids``, ``labels``, ``attention_mask`` of character codes and the flag."""
    encoded = encode_pair(char_ids(F.col(prompt)), char_ids(F.col(response)), max_length, max_prompt)
    return rows.withColumn("_e", encoded).select(*[c for c in rows.columns if c not in (prompt, response)], "_e.*").withColumn(desirable, F.col(desirable).cast("boolean"))


def joined_ids(prompt: Column, response: Column, max_length: int = 512) -> Column:
    """Struct of ``input_ids``, prompt and response as one text cut or padded with 0, and ``attention_mask``, 1 where an id
    is not 0."""
    ids = F.slice(char_ids(F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(response, F.lit("")))), 1, max_length)
    full = F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_length) - F.size(ids)))
    return F.struct(full.alias("input_ids"), F.transform(full, lambda x: (x != 0).cast("int")).alias("attention_mask"))


def collate(batches: DataFrame, ids: str = "input_ids", batch: str = "batch", pad: int = 0) -> DataFrame:
    """Ids padded on the right to the longest of their batch, with ``attention_mask``."""
    most = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = F.col("_most") - F.size(ids)
    out = batches.withColumn("_most", most)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))
    return out.withColumn("attention_mask", mask).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), fill))).drop("_most")


def ranking_pairs(ranked: DataFrame, group: str = "prompt_id", rank: str = "rank", text: str = "text", most: int | None = None, seed: int = 42) -> DataFrame:
    """``group``, ``chosen``, ``rejected``: every pair of a ranking, better first; ``most`` keeps that many by seeded hash."""
    better = ranked.select(group, F.col(rank).alias("ra"), F.col(text).alias("chosen"))
    worse = ranked.select(group, F.col(rank).alias("rb"), F.col(text).alias("rejected"))
    pairs = better.join(worse, group).where("ra < rb")
    if most is not None:
        order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), "ra", "rb"))
        pairs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
    return pairs


def cot_prompt(question: Column, examples: list[tuple[str, str]] = ()) -> Column:
    """Worked examples, then the question and the call to think in steps."""
    shown = "".join(f"Q: {q}\nA: {a}\n\n" for q, a in examples)
    return F.concat(F.lit(shown + "Q: "), question, F.lit("\nA: Let's think step by step."))
