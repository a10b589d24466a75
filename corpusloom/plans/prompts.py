"""Prompts of multiple-choice, numeric and ending tasks as column expressions; exemplars are given, none are built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def options(columns: dict[str, Column]) -> Column:
    """A. …, one a line, absent ones left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}. "), c) for k, c in sorted(columns.items())))


#: How the benchmarks' prompts begin, what stands before a question and its answer, and how a worked answer ends.
FORMS = {
    "arc": {"intro": "The following are multiple choice questions about science and reasoning. You MUST choose one of the option A~D.\n", "ask": "", "reply": "Response:", "think": "Let's think step by step.", "so": "#### Therefore Answer:"},
    "ko_arc": {"intro": "다음은 과학과 추론에 관한 객관식 문제들입니다. A부터 D까지의 보기중 무조건 하나의 답만 선택하세요.\n", "ask": "", "reply": "응답:", "think": "단계적으로 생각해봅시다.", "so": "#### 따라서 정답:"},
    "hellaswag": {"intro": "The following are reading comprehension questions. Choose the most logical continuation from the given options.\n", "ask": "Context: ", "reply": "#### Answer:", "think": "Let's think step by step.", "so": "#### Therefore, the answer is:"},
    "ko_hellaswag": {"intro": "다음은 독해 문제들입니다. 주어진 선택지 중 가장 논리적인 연속을 선택하세요.\n", "ask": "Context: ", "reply": "#### 정답:", "think": "단계별로 생각해봅시다.", "so": "#### 따라서 정답은:"},
    "piqa": {"intro": "The following are multiple choice questions about physical commonsense.\n", "ask": "Goal: ", "reply": "Response: Let's think step by step.", "think": "", "so": "#### Therefore the answer is"},
    "ko_piqa": {"intro": "다음은 물리적 상식에 대한 다지선다형 질문입니다.\n", "ask": "Goal: ", "reply": "응답: 단계적으로 생각해봅시다.", "think": "", "so": "#### 따라서 정답은"},
}
NUMERIC_FORMS = {
    "gsm8k": {"ask": "Question: ", "reply": "Response:", "think": "Let's think step by step.", "so": "#### So the answer is"},
    "hrm8k": {"ask": "문제: ", "reply": "응답:", "think": "단계별로 생각해봅시다.", "so": "#### 따라서 정답은"},
}


def few_shot(form: str, exemplars: list[dict], question: Column, choices: dict[str, Column]) -> Column:
    """A benchmark's prompt: its intro, worked exemplars (question, options, reasoning, answer) with sorted options, the question with its
    own, and what the reply begins with. Without exemplars: zero-shot."""
    f = FORMS[form]
    gap = [""] if f["think"] else []
    lines = [f["intro"]]
    for e in exemplars:
        lines += [f["ask"] + e["question"], *(f"{k}. {x}" for k, x in sorted(e["options"].items())), f"{f['reply']} {e['reasoning']} {f['so']} {{{e['answer']}}}. #### {{{e['answer']}}}.", ""]
    end = [*gap, " ".join(x for x in (f["reply"], f["think"]) if x)]
    return F.concat_ws("\n", *map(F.lit, lines), F.concat(F.lit(f["ask"]), question), options(choices), *map(F.lit, end))


def few_shot_numeric(form: str, exemplars: list[dict], question: Column) -> Column:
    """As few_shot, of questions with a number for an answer."""
    f = NUMERIC_FORMS[form]
    shown = [f"{f['ask']}{e['question']}\n {f['reply']} {e['reasoning']} {f['so']} {{{e['answer']}}}. #### {{{e['answer']}}}" for e in exemplars]
    return F.concat(F.lit("\n\n".join([*shown, f["ask"]])), question, F.lit(f"\n{f['reply']} {f['think']}"))


def zero_shot_subject(subject: Column, question: Column, choices: dict[str, Column], intro: tuple[str, str] = ("다음은 ", "에 관한 객관식 문제입니다."), ending: str = "정답:", names: dict[str, str] | None = None) -> Column:
    """A subject's question without exemplars; names: how subjects are shown, others with blanks for underscores."""
    plain = F.replace(subject, F.lit("_"), F.lit(" "))
    shown = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), subject), plain) if names else plain
    return F.concat_ws("\n", F.concat(F.lit(intro[0]), shown, F.lit(intro[1])), F.lit(""), question, options(choices), F.lit(ending))


def choice(question: Column, columns: dict[str, Column], exemplars: list[str] | None = None, ending: str = "Answer:") -> Column:
    """Exemplars (few-shot), the question, its options and the ending; without exemplars zero-shot."""
    return F.concat_ws("\n", *(F.lit(x) for x in exemplars or []), F.concat(F.lit("Question: "), question), options(columns), F.lit(ending))


def solved(letter: Column | str) -> Column:
    """How an exemplar ends."""
    x = F.lit(letter) if isinstance(letter, str) else letter
    return F.concat(F.lit("#### {"), x, F.lit("}"))


def numeric(question: Column, exemplars: list[str] | None = None) -> Column:
    return F.concat_ws("\n\n", *(F.lit(x) for x in exemplars or []), F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")))


def endings(context: Column, choices: Column) -> Column:
    lettered = F.transform(choices, lambda e, i: F.concat(F.char(i + 65), F.lit(". "), e))
    return F.concat(F.lit("Context: "), context, F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\nAnswer:"))


def two(goal: Column, a: Column, b: Column) -> Column:
    return choice(goal, {"A": a, "B": b})


def missing_fields(template: str, fields: list[str]) -> list[str]:
    """Names in {{…}} of a template that no field begins with."""
    import re

    return sorted({m.strip() for m in re.findall(r"\{\{(.*?)\}\}", template) if m.strip().split(".")[0] not in fields})


#: The forms of the benchmarks by subject.
SUBJECT_FORMS = {
    "mmlu": {
        "zero": ("The following is a multiple choice question about ", "."), "few": ("The following are multiple choice questions about various topics including ", "."), "ask": "Question: ", "absent": "Option ", "reply": "Answer:",
        "so": "#### The correct answer is", "rule": "You should ONLY choose one of the letters A, B, C, or D as your final answer.", "begin": "Answer: The correct answer is",
    },
    "kmmlu": {
        "zero": ("다음은 ", "에 관한 객관식 문제입니다."), "few": ("다음은 다양한 주제(", " 포함)에 대한 객관식 문제입니다."), "ask": "문제: ", "absent": "선택지 ", "reply": "정답:",
        "so": "#### 따라서 정답은", "rule": "정답을 A, B, C, D 중 오직 하나의 문자로만 선택해주세요.", "begin": "정답: 따라서 정답은",
    },
}
#: The Korean names of the subjects, for prompts without exemplars.
SUBJECTS = {
    "abstract_algebra": "추상대수학", "anatomy": "해부학", "astronomy": "천문학", "business_ethics": "경영 윤리", "clinical_knowledge": "임상 지식", "college_biology": "대학 생물학",
    "college_chemistry": "대학 화학", "college_computer_science": "대학 컴퓨터 과학", "college_mathematics": "대학 수학", "college_medicine": "대학 의학", "college_physics": "대학 물리학",
    "computer_security": "컴퓨터 보안", "conceptual_physics": "개념 물리학", "econometrics": "계량경제학", "electrical_engineering": "전기공학", "elementary_mathematics": "초등 수학",
    "formal_logic": "형식 논리학", "global_facts": "세계 사실", "high_school_biology": "고등학교 생물학", "high_school_chemistry": "고등학교 화학", "high_school_computer_science": "고등학교 컴퓨터 과학",
    "high_school_european_history": "고등학교 유럽사", "high_school_geography": "고등학교 지리학", "high_school_government_and_politics": "고등학교 정치학", "high_school_macroeconomics": "고등학교 거시경제학",
    "high_school_mathematics": "고등학교 수학", "high_school_microeconomics": "고등학교 미시경제학", "high_school_physics": "고등학교 물리학", "high_school_psychology": "고등학교 심리학",
    "high_school_statistics": "고등학교 통계학", "high_school_us_history": "고등학교 미국사", "high_school_world_history": "고등학교 세계사", "human_aging": "인간 노화", "human_sexuality": "인간 성학",
    "international_law": "국제법", "jurisprudence": "법학", "logical_fallacies": "논리적 오류", "machine_learning": "기계학습", "management": "경영학", "marketing": "마케팅",
    "medical_genetics": "의학 유전학", "miscellaneous": "기타", "moral_disputes": "도덕적 논쟁", "moral_scenarios": "도덕적 시나리오", "nutrition": "영양학", "philosophy": "철학", "prehistory": "선사학",
    "professional_accounting": "전문 회계학", "professional_law": "전문 법학", "professional_medicine": "전문 의학", "professional_psychology": "전문 심리학", "public_relations": "홍보학",
    "security_studies": "보안학", "sociology": "사회학", "us_foreign_policy": "미국 외교정책", "virology": "바이러스학", "world_religions": "세계 종교학",
}
#: The forms of the benchmark with ten options.
TEN_FORMS = {
    "en": {
        "zero": "Read the following question, Let's think step by step, and provide the final answer in the format '#### Answer: [Option]'.", "think": "Let's think step by step.",
        "few": "The following are challenging multiple choice questions from various academic disciplines. You MUST choose one of the option A~J.\n", "so": ("#### So the answer is ", "."), "end": ("#### Answer: ", "."), "reply": "Response: Let's think step by step.",
    },
    "ko": {
        "zero": "다음 질문을 읽고, 이제 단계적으로 생각하여 최종 정답을 '#### 정답: [선택지]' 형식으로 제시하시오.", "think": "단계적으로 생각해봅시다.",
        "few": "다음은 다양한 학문 분야의 전문적이고 어려운 다지선다형 질문입니다. A부터 J까지의 보기중 무조건 하나의 답만 선택하세요.\n", "so": ("#### 따라서 정답은 ", " 입니다."), "end": ("#### 정답: ", ""), "reply": "응답: 단계별로 생각해봅시다.",
    },
}


def _four(form: dict, choices: dict[str, Column]) -> list[Column]:
    """The options A to D; an absent one (null, or no column) shows its name alone."""
    return [F.concat(F.lit(f"{k}. "), F.coalesce(choices.get(k, F.lit(None).cast("string")), F.lit(form["absent"] + k))) for k in "ABCD"]


def _titled(subject: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(subject, F.lit("unknown")), F.lit("_"), F.lit(" ")))


def subject_question(form: str, subject: Column, question: Column, choices: dict[str, Column]) -> Column:
    """A question by subject without exemplars; the Korean form has the subject's Korean name, if there is one, and blanks for underscores otherwise."""
    f = SUBJECT_FORMS[form]
    named = F.create_map(*(F.lit(x) for kv in SUBJECTS.items() for x in kv))
    known = F.coalesce(subject, F.lit("unknown"))
    shown = _titled(subject) if form == "mmlu" else F.coalesce(F.try_element_at(named, known), F.replace(known, F.lit("_"), F.lit(" ")))
    return F.concat_ws("\n", F.concat(F.lit(f["zero"][0]), shown, F.lit(f["zero"][1])), F.lit(""), F.coalesce(question, F.lit("")), *_four(f, choices), F.lit(f["reply"]))


def subject_few_shot(form: str, exemplars: list[dict], subject: Column, question: Column, choices: dict[str, Column]) -> Column:
    """As subject_question after worked exemplars (question, options, answer), with the rule for the answer and its beginning."""
    f = SUBJECT_FORMS[form]
    lines = []
    for e in exemplars:
        lines += [f["ask"] + e["question"], *(f"{k}. {x}" for k, x in sorted(e["options"].items())), f"{f['reply']} {f['so']} {{{e['answer']}}}. #### {{{e['answer']}}}", ""]
    head = F.concat(F.lit(f["few"][0]), _titled(subject), F.lit(f["few"][1]))
    return F.concat_ws("\n", head, F.lit(""), *map(F.lit, lines), F.concat(F.lit(f["ask"]), F.coalesce(question, F.lit(""))), *_four(f, choices), F.lit(""), F.lit(f["rule"]), F.lit(f["begin"]))


def _ten(options: Column) -> Column:
    """The options of an array of ten, lettered by their place; null, blank and N/A ones are left out."""
    shown = F.filter(F.transform(options, lambda x, i: F.when(~F.trim(x).isin("", "N/A"), F.concat(F.char(i + 65), F.lit(". "), x))), lambda x: x.isNotNull())
    return F.when(F.size(shown) > 0, F.array_join(shown, "\n"))


def ten_options(language: str, exemplars: list[dict], question: Column, options: Column) -> Column:
    """A question of up to ten options (an array), after worked exemplars (question, options, reasoning, answer) or, without, after the instruction alone."""
    f = TEN_FORMS[language]
    lines = [f["few"]] if exemplars else [f["zero"], ""]
    for e in exemplars:
        lines += [f"Question: {e['question']}", *(f"{k}. {x}" for k, x in sorted(e["options"].items())), e["reasoning"], e["answer"].join(f["so"]), e["answer"].join(f["end"]), ""]
    return F.concat_ws("\n", *map(F.lit, lines), F.concat(F.lit("Question: "), F.coalesce(question, F.lit(""))), _ten(options), F.lit(""), F.lit(f["reply"] if exemplars else f["think"]))
