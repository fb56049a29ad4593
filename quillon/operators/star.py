"""The seven-table star: an average over a chain of inner joins, with two equality filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_score(marks: DataFrame, enrollments: DataFrame, students: DataFrame, classrooms: DataFrame, assignments: DataFrame, subjects: DataFrame, schools: DataFrame, subject: str = "Mathematics", grade: str = "8") -> DataFrame:
    """board and avg_score over the marks of one subject's and grade's classrooms.

    ``grade`` is compared as text, whatever type the column has. Assignments join
    by classroom alone, so a mark counts once for each matching assignment: their
    number is a weight, so that no mark is multiplied before it is summed up.
    """
    picked = assignments.alias("a").join(subjects.where(F.col("name") == subject).alias("b"), F.col("a.subject_id") == F.col("b.id")).groupBy("a.classroom_id").agg(F.count("*").alias("weight"))
    rooms = classrooms.where(F.col("grade").cast("string") == grade).select(F.col("id").alias("classroom_id"))
    seats = enrollments.select(F.col("id").alias("enrollment_id"), "student_id", "classroom_id").join(rooms, "classroom_id").join(picked, "classroom_id")
    pupils = students.select(F.col("id").alias("student_id"), "school_id")
    boards = schools.select(F.col("id").alias("school_id"), "board")
    joined = marks.select("enrollment_id", "score").join(seats, "enrollment_id").join(pupils, "student_id").join(boards, "school_id")
    score = F.col("score").cast("double")
    return joined.groupBy("board").agg((F.sum(score * F.col("weight")) / F.sum(F.when(score.isNotNull(), F.col("weight")))).alias("avg_score"))
