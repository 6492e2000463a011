"""Instruction pairs: signatures, wording, prompt parts within a token budget, and emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.keys import CLASS_LIKE
from loomline.operators.fragments import position_mode

#: The wording of instructions.
VERBS = ("Write", "Create", "Develop", "Provide implementation of", "Produce")
DECLARED = {"var_decl": "variable", "enum_decl": "enumeration"}
PROMPTS = {
    "class": "Implement class with name {name}",
    "method": "Implement method with name {name}",
    "class_method": "Implement method of class {class_name} with name {name}",
    "function": "Implement function with name {name}",
    "template": "Implement template with name {name}",
    "class_template": "Implement class template with name {name}",
    "namespace": "Implement namespace with name {name}",
    "lambda": "Implement lambda expression",
    "error_handler": "Implement error handler",
    "macro": "Implement macro with name {name}",
    "preprocessor": "Implement preprocessor directive",
    "literal": "Implement user-defined literal with name {name}",
    "attribute": "Implement attribute with name {name}",
}
SKIPPED = ("namespace", "lambda", "error_handler")
#: What is asked for a docstring; the code takes the place of None. Any wording will do.
DOCSTRING_REQUEST = ("Document this C++ code in English.", "Code:", None, "Use this form for the comment, with those tags that apply, and answer with it alone: /** @brief, @param, @return, @throws, @note */")


def signature(kind: Column, parent: Column, sig: Column) -> Column:
    """A declaration from a signature struct.

    As the format has it, the last of static, virtual, const, noexcept is left out in front (so ``const noexcept``
    says const twice), and there is nothing in front of pure virtual ones.
    """
    q = sig["qualifiers"]
    marks = F.filter(
        F.array(*(F.when(q[f], w) for f, w in (("is_static", "static"), ("is_virtual", "virtual"), ("is_const", "const"), ("is_noexcept", "noexcept")))),
        lambda x: x.isNotNull(),
    )
    pure = F.coalesce(q["is_pure_virtual"], F.lit(False))
    front = F.when(pure | (F.size(marks) == 0), F.array().cast("array<string>")).otherwise(F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0))))

    def parameter(p: Column) -> Column:
        return F.concat(p["type"], F.when(F.coalesce(p["name"], F.lit("")) != "", F.concat(F.lit(" "), p["name"])).otherwise(""), F.coalesce(F.concat(F.lit(" = "), p["default_value"]), F.lit("")))

    args = F.concat(F.lit("("), F.array_join(F.transform(sig["parameters"], parameter), ", "), F.lit(")"))
    own = F.concat(parent, F.lit("::"))
    name = (
        F.when(kind == "destructor", F.concat(own, F.lit("~"), sig["name"], F.lit("()")))
        .when(kind.isin("constructor", "cxx_method", "method_template"), F.concat(own, sig["name"], args))
        .otherwise(F.concat(sig["name"], args))
    )
    special = kind.isin("constructor", "destructor")
    return F.array_join(
        F.concat(
            front,
            F.array(F.when(~special, sig["return_type"]), name, F.when(~special & q["is_const"], "const"), F.when(q["is_noexcept"], "noexcept"), F.when((kind != "constructor") & pure, "= 0")),
        ),
        " ",
    )


def verb(key: Column) -> Column:
    """A verb that depends on key only, in place of a random one."""
    return F.element_at(F.array(*map(F.lit, VERBS)), (T.hash_choice(key, len(VERBS)) + 1).cast("int"))


def instruction(kind: Column, name: Column, parent_type: Column, parent: Column, mode: Column, idx: Column, key: Column, suffix: str = "project sources") -> Column:
    """The wording for a kind and a mode: whole, first, next, last or docstring. Unknown kinds give null."""
    is_method = (kind == "cxx_method") | ((kind == "function_template") & F.coalesce(parent_type.isin(*CLASS_LIKE), F.lit(False)))
    is_function = kind.isin("function_decl", "function_template") & ~is_method
    declared = kind.isin(*DECLARED)
    what = (
        F.when(is_method, F.concat(F.lit("method "), name, F.lit(" of the C++ class "), parent))
        .when(is_function, F.concat(F.lit("C++ function "), name))
        .when(kind == "constructor", F.concat(F.lit("constructor of the C++ class "), parent))
        .when(kind == "destructor", F.concat(F.lit("destructor of the C++ class "), parent))
        .when(kind.isin(*CLASS_LIKE), F.concat(F.lit("C++ class "), name))
    )
    for k, word in DECLARED.items():
        what = F.when(kind == k, F.concat(F.lit(word + " "), name, F.lit(f" of the {suffix}"))).otherwise(what)
    nth = F.when(is_function | kind.isin(*CLASS_LIKE), "fragment (#").otherwise("the next fragment (#")
    part = F.when(mode == "first", "the first fragment of ").when(mode == "next", F.concat(nth, idx, F.lit(") of "))).when(mode == "last", "the last fragment of ").otherwise("")
    start = F.when(declared, "Declare").otherwise(verb(key))
    return F.when(mode == "docstring", F.concat(F.lit("Write documentation (docstring) for the "), what)).otherwise(F.concat(start, F.lit(" "), part, F.lit("the "), what))


def within_budget(parts: dict[str, Column], budget: int = 512, removal: tuple[str, ...] = ("comments", "context", "location")) -> tuple[Column, Column]:
    """P16, P17 as expressions for short texts: (the parts joined, still_too_long). ``budgeted`` counts each part once."""
    left, shown = sum((T.token_count(c) for c in parts.values()), F.lit(0).cast("long")), dict(parts)
    for n in removal:
        if n in parts:
            over = left > budget
            shown[n] = F.when(~over, parts[n])
            left = F.when(over, left - T.token_count(parts[n])).otherwise(left)
    return F.concat(*(F.coalesce(c, F.lit("")) for c in shown.values())), left > budget


def budgeted(rows: DataFrame, parts: dict[str, Column], budget: int = 512, removal: tuple[str, ...] = ("comments", "context", "location"), into: tuple[str, str] = ("prompt", "too_long")) -> DataFrame:
    """Rows with the parts joined, and whether they are still over budget. While the parts' tokens are over
    budget the ones in ``removal`` go, in that order; nothing is cut. Null parts are absent.

    Tokens are counted once per part, in a projection of their own: a total, what is left of it after each removal, and last the text.
    """
    name = lambda kind, n: f"_{into[0]}_{kind}_{n}"
    held = rows.withColumns({name("text", n): F.coalesce(c, F.lit("")) for n, c in parts.items()})
    held = held.withColumns({name("tokens", n): T.token_count(F.col(name("text", n))) for n in parts})
    total = F.lit(0).cast("long")
    for n in parts:
        total = total + F.col(name("tokens", n))
    held = held.withColumn(name("left", "all"), total)
    last, shown = name("left", "all"), {n: F.col(name("text", n)) for n in parts}
    for n in removal:
        if n in parts:
            over = F.col(last) > budget
            shown[n] = F.when(over, "").otherwise(shown[n])
            held = held.withColumn(name("left", n), F.when(over, F.col(last) - F.col(name("tokens", n))).otherwise(F.col(last)))
            last = name("left", n)
    return held.withColumns({into[0]: F.concat(*shown.values()), into[1]: F.col(last) > budget}).drop(*(c for c in held.columns if c not in rows.columns))


def docstring_prompt(code: Column, request: tuple[str | None, ...] = DOCSTRING_REQUEST) -> Column:
    """A request around the code, line by line."""
    return F.concat_ws("\n", *(code if x is None else F.lit(x) for x in request))


def chat_messages(*turns: tuple[str, Column]) -> Column:
    """array<struct<role, content>>."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def answer_budget(answer: Column, prompt_tokens: Column) -> Column:
    """P30."""
    return F.least(answer, F.greatest(F.lit(2048), 2 * prompt_tokens))


def simple_prompt(kind: Column, name: Column, class_name: Column | None = None) -> Column:
    """The prompt of a record of the nested format; null for kinds that are skipped."""
    out = F.concat(F.lit("Implement "), kind, F.lit(" with name "), name)
    for k, form in PROMPTS.items():
        text = F.replace(F.lit(form), F.lit("{name}"), F.coalesce(name, F.lit("")))
        out = F.when(kind == k, text if class_name is None else F.replace(text, F.lit("{class_name}"), class_name)).otherwise(out)
    return F.when(~kind.isin(*SKIPPED), out)


def nested_pairs(classes: DataFrame) -> DataFrame:
    """F8: (name, ord, input, output): a pair for each class and one for each of its methods. classes are read once."""
    kind = classes.schema["methods"].dataType
    own = F.array(F.lit(None).cast(kind.elementType))  # stands for the class, before its methods
    m = classes.select("name", "declaration", F.posexplode(F.concat(own, F.coalesce("methods", F.array().cast(kind)))).alias("ord", "m"))
    first = F.col("ord") == 0
    prompt = F.when(first, simple_prompt(F.lit("class"), F.col("name"))).otherwise(simple_prompt(F.lit("class_method"), F.col("m.name"), F.col("name")))
    return m.select("name", "ord", prompt.alias("input"), T.strip(F.coalesce(F.when(first, F.col("declaration")).otherwise(F.col("m.code")), F.lit(""))).alias("output"))


def method_rows(classes: DataFrame) -> DataFrame:
    """one row per method of nested classes: (class_name, method...)."""
    return classes.select(F.col("name").alias("class_name"), F.explode("methods").alias("m")).select("class_name", "m.*")


def find_method(classes: DataFrame, class_name: str, method: str) -> DataFrame:
    """The first method of that name in the first class of that name that has one; no row if there is none. Classes are told apart by ``id``."""
    own = classes.where(F.col("name") == class_name).select("id", F.posexplode("methods").alias("pos", "m"))
    return own.where(F.col("m.name") == method).orderBy("id", "pos").limit(1).select("id", "m.*")


def all_methods(direct: DataFrame, classes: DataFrame) -> DataFrame:
    """methods that are rows of their own and those nested in classes: (class_name, name, code, ...)."""
    return direct.unionByName(method_rows(classes), allowMissingColumns=True)


def emitted(elements: DataFrame, pieces: DataFrame, budget: int = 512) -> DataFrame:
    """elements (id, code) with mode, idx and output: whole if within budget, else their pieces (id, idx, code)."""
    counted = elements.withColumn("tokens", T.token_count(F.col("code")))
    whole = counted.where(F.col("tokens") <= budget).withColumn("mode", F.lit("whole")).withColumn("idx", F.lit(0)).withColumn("output", F.col("code"))
    n = pieces.groupBy("id").agg(F.count("*").alias("n"))
    cut = counted.where(F.col("tokens") > budget).join(pieces.select("id", "idx", F.col("code").alias("output")), "id").join(n, "id")
    return whole.unionByName(cut.withColumn("mode", position_mode()).drop("n"))


def documentation_pairs(elements: DataFrame) -> DataFrame:
    """a pair for each element (instruction, code, docstring) whose cleaned docstring is not empty."""
    doc = T.clean_docstring(F.coalesce("docstring", F.lit("")))
    rows = elements.withColumn("output", F.explode(F.array(doc))).where("output <> ''")  # exploded, it is cleaned once, not in the filter as well
    return rows.select("id", F.concat(F.col("instruction"), F.lit(" with code: "), F.col("code")).alias("input"), "output")
