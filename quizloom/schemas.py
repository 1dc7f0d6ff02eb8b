"""Schemas of the tables that the operators read."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


INT, LONG, TEXT, REAL, FLAG, STAMP = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

#: Fixed: the fields of a pick entry, in their order.
PICK_FIELDS = [
    "id", "exam_board", "syllabus_code", "level", "year", "session", "paper", "question", "parent_question", "part", "marks",
    "syllabus_codes", "topic_titles", "skills", "question_type", "practical_topic", "difficulty", "learning_outcomes",
    "learning_outcome_texts", "learning_objectives", "command_words", "ms_answer", "mark_scheme", "body", "figures",
]

QUESTION = _struct(
    id=TEXT, exam_board=TEXT, syllabus_code=TEXT, level=TEXT, year=INT, session=TEXT, paper=TEXT, question=TEXT, parent_question=TEXT, part=TEXT, marks=INT,
    syllabus_codes=STRINGS, topic_titles=STRINGS, skills=STRINGS, question_type=TEXT, practical_topic=TEXT, difficulty=INT, difficulty_source=TEXT,
    learning_outcomes=STRINGS, learning_outcome_texts=STRINGS, learning_objectives=STRINGS, command_words=STRINGS, misconceptions=STRINGS,
    common_errors=STRINGS, common_incorrect=TEXT, examiner_report_source=TEXT, er_year=INT, er_session=TEXT, er_paper=TEXT, examiner_band=TEXT, examiner_notes=TEXT,
    facility=REAL, percent_correct=REAL, discrimination=REAL, ms_answer=TEXT, mark_scheme=TEXT, body=TEXT, figures=STRINGS,
    source_qp=TEXT, source_ms=TEXT, page_qp=INT, page_ms=INT,
)

REPORT_QUESTION = _struct(
    year=INT, session=TEXT, paper=TEXT, question=TEXT, ms_key=TEXT, examiner_band=TEXT, difficulty=INT, difficulty_source=TEXT,
    common_incorrect=TEXT, common_errors=STRINGS, examiner_notes=TEXT, facility=REAL, percent_correct=REAL, discrimination=REAL,
)

ASSIGNMENTS = _struct(id=LONG, title=TEXT, question_ids=STRINGS, created_at=STAMP, due_at=STAMP)
STUDENTS = _struct(id=LONG, name=TEXT, student_no=TEXT, class_name=TEXT, created_at=STAMP)
ANSWERS = _struct(id=LONG, assignment_id=LONG, student_id=LONG, question_id=TEXT, chosen=TEXT, correct=FLAG, answered_at=STAMP)

REGISTRY = _struct(
    id=TEXT, year=INT, session=TEXT, season=TEXT, paper=TEXT, board=TEXT, syllabus_code=TEXT, qp=TEXT, ms=TEXT, er=TEXT, draft=TEXT, status=TEXT, notes=TEXT, updated_at=TEXT,
)

SPANS = _struct(doc=TEXT, page=INT, ord=INT, x0=REAL, y0=REAL, x1=REAL, y1=REAL, text=TEXT, size=REAL)
BOXES = _struct(doc=TEXT, page=INT, ord=INT, x0=REAL, y0=REAL, x1=REAL, y1=REAL)
FILES = _struct(path=TEXT, size=LONG, width=INT, height=INT)
