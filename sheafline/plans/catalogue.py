"""Prompt catalogue, vocabulary and model registry as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Texts and names that results are compared on.

VOCABULARY = """Бавовна – іронічне позначення вибухів на території Росії або окупованих територіях, яке виникло через цензуру в російських медіа. Замінює слово «вибух» у контексті ударів по ворожих об'єктах.

Двохсотий – військовий термін, що означає загиблого солдата (походить від радянської кодової назви «вантаж 200» для транспортування тіл загиблих).

Приліт – потрапляння ракети, снаряду або дрону в ціль, зазвичай супроводжується вибухом.

Трьохсотий – військовий термін, що означає пораненого солдата (походить від кодової назви «вантаж 300» для евакуації поранених).

Прилетіти – отримати влучання ракетою чи снарядом, зазвичай використовується щодо обстрілів міст, військових об'єктів або техніки.

Втомитися – евфемізм, яким часто описують стан російських систем ППО або техніки після удару ЗСУ.

Пташка – безпілотник або літальний апарат, який виконує розвідувальні чи ударні завдання.

Ціль – об'єкт, по якому планується завдати удару (наприклад, військова техніка, командний пункт, склад боєприпасів).

Спеціальна воєнна операція – евфемістичний термін, який Росія використовує для позначення свого повномасштабного вторгнення в Україну з метою уникнення слова «війна».

Щит – живий щит, тобто цивільні або мобілізовані, яких російські війська використовують для прикриття своїх позицій.

Приземлити – збити ворожий літак, безпілотник чи ракету.

Мопед – іронічна назва іранського дрона-камікадзе «Shahed», який використовується Росією для ударів по українській інфраструктурі (через характерний звук двигуна, схожий на мотор мопеда).

Батальйон Монако – саркастичний термін для українських багатіїв та політиків, які втекли за кордон під час війни, особливо в дорогі курортні місця на кшталт Монако.

Дискотека – масований обстріл або бомбардування, часто супроводжується вибухами та загравою.

Зоряні війни – протиповітряний бій із застосуванням ППО, коли в небі видно сліди від збитих ракет або дронів.

За рускім кораблем – скорочена форма українського військового мему «Русскій корабль, іді нах*й!», що став символом спротиву російській агресії.

Дружній вогонь – випадковий обстріл своїх військ або техніки, часто через погану координацію або паніку.

На концерт до Кобзона – евфемізм, який означає загибель російських військових чи командирів (Йосип Кобзон – радянський співак, що підтримував російську агресію, помер у 2018 році).

Мінусувати – знищувати ворожу техніку або живу силу (наприклад, «мінуснули танк» – знищили танк).

М'ясо – мобілізовані солдати, яких російське командування кидає в бій без належної підготовки та забезпечення (також відоме як «м'ясні штурми»).

Відпрацювати – завдати удару по ворожій позиції або техніці (наприклад, «артилерія відпрацювала по складу БК»).

Нуль – передова лінія фронту, найнебезпечніше місце, де тривають активні бойові дії.

На щиті – вираз, що означає загибель військового у бою. Походить із давньої традиції, коли загиблих воїнів приносили з поля бою на щитах. У сучасному контексті використовується як синонім терміна «двохсотий»."""

WORD_LIST = "бавовна, двохсотий, приліт, трьохсотий, прилетіти, втомитися, пташка, ціль, спеціальна воєнна операція, щит, приземлити, мопед, Батальон Монако, дискотека, зоряні війни, за рускім кораблем, дружній вогонь, на концерт до Кобзона, мінусувати, м'ясо, відпрацювати, нуль"

PROMPTS = {
    1: "Напиши лише цифру 1, якщо вираз в кутових дужках є евфемізмом, інакше  0. ",
    2: "Напиши 1, якщо вираз в кутових дужках є евфемізмом, інакше  0. Також напиши, в якому значенні використано цей вираз",
    3: """Ти - лінгвіст, який має визначити, чи слово в кутових дужках є евфемізмом. 
Як відповідь напиши 1, якщо слово в кутових дужках використано, як евфемізм, і 0, якщо використане в звичному значенні. 
Також напиши один синонім або гіперонім до цього слова. 
Вважай, що ці слова є евфемізмами в контексті війни: 
"""
    + VOCABULARY,
    4: """Проаналізуй текст і визнач, чи вираз в кутових дужках є евфемізмом.
Спочатку коротко опиши пряме значення цього виразу, потім його можливе переносне значення в даному контексті.
На основі цього аналізу напиши 1, якщо це евфемізм, або 0, якщо вираз використано в прямому значенні.""",
    5: """Ти аналізуєш тексти з контексту російсько-української війни.
Визнач, чи вираз в кутових дужках використовується як евфемізм.
Напиши лише 1, якщо це евфемізм, або 0, якщо вираз використано в прямому значенні.""",
}

DEFAULT_MODELS = {
    "deepseek": "deepseek-v4-flash",
    "openai": "gpt-5.4",
    "gemini": "gemini-3.1-flash-lite",
    "lapa": "lapa-llm/lapa-v0.1.2-instruct",
    "mamaylm": "INSAIT-Institute/MamayLM-Gemma-3-12B-IT-v1.0",
    "qwen": "Qwen/Qwen2.5-7B-Instruct",
    "groq": "meta-llama/llama-4-scout-17b-16e-instruct",
    "xai": "grok-3",
    "openrouter": "google/gemini-2.5-flash",
}

DEFAULT_ROWS_PER_SHEET = 5
DEFAULT_TOTAL_ROWS = 50
# ---------------------------------------------------------------------------------------------


def prompt_text(number: int) -> str:
    """Catalogue prompt by its 1-based number."""
    if number not in PROMPTS:
        raise ValueError(f"prompt number must be 1-{len(PROMPTS)}, got {number}")
    return PROMPTS[number]


def prompt_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROMPTS.items()), "prompt_no int, prompt string")


def parse_vocabulary(df: DataFrame, blob: str = "vocabulary") -> DataFrame:
    """``term, definition`` from paragraphs ``term – definition``; other columns are kept."""
    rest = [c for c in df.columns if c != blob]
    entries = df.select(*rest, F.explode(F.split(blob, "\n\n")).alias("_entry"))
    parts = F.split("_entry", " – ", 2)
    return entries.select(*rest, F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).alias("definition"))


def parse_word_list(df: DataFrame, blob: str = "words") -> DataFrame:
    """One row per term of a comma list."""
    rest = [c for c in df.columns if c != blob]
    return df.select(*rest, F.explode(F.split(blob, ", ")).alias("term"))
