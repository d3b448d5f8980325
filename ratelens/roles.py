"""Semantic roles: operators are name-independent; a Roles object binds names.

``HR_ROLES`` binds the original employee-table column names, ``FACT_ROLES`` the
columns of the ``fact`` view built from the driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    outcome: str            # string outcome column (positive / negative value)
    label: str              # 0/1 integer outcome column
    positive: str
    negative: str
    row_id: str
    dept: str
    role: str
    gender: str
    marital: str
    education_field: str
    travel: str
    overtime: str
    age: str
    income: str
    level: str
    experience: str
    tenure: str
    role_years: str
    job_sat: str
    env_sat: str
    rel_sat: str
    balance: str
    travel_frequent: str
    travel_rare: str
    single: str
    yes: str = "Yes"
    categoricals: tuple[str, ...] = field(default_factory=tuple)
    numerics: tuple[str, ...] = field(default_factory=tuple)

    @property
    def satisfaction(self) -> tuple[str, ...]:
        return (self.job_sat, self.env_sat, self.rel_sat, self.balance)


# --- fixed values: column names of the original employee table -------------------------------
HR_CATEGORICALS = ("Department", "JobRole", "Gender", "MaritalStatus", "EducationField",
                   "BusinessTravel", "OverTime")
HR_NUMERICS = ("Age", "MonthlyIncome", "TotalWorkingYears", "YearsAtCompany", "YearsInCurrentRole",
               "YearsSinceLastPromotion", "JobLevel", "Education", "DistanceFromHome", "WorkLifeBalance",
               "JobSatisfaction", "EnvironmentSatisfaction", "JobInvolvement", "DailyRate", "HourlyRate",
               "MonthlyRate", "NumCompaniesWorked", "PercentSalaryHike", "PerformanceRating",
               "RelationshipSatisfaction", "StockOptionLevel", "TrainingTimesLastYear", "YearsWithCurrManager")

HR_ROLES = Roles(
    outcome="Attrition", label="Attrition_Numeric", positive="Yes", negative="No", row_id="EmployeeNumber",
    dept="Department", role="JobRole", gender="Gender", marital="MaritalStatus",
    education_field="EducationField", travel="BusinessTravel", overtime="OverTime",
    age="Age", income="MonthlyIncome", level="JobLevel", experience="TotalWorkingYears",
    tenure="YearsAtCompany", role_years="YearsInCurrentRole", job_sat="JobSatisfaction",
    env_sat="EnvironmentSatisfaction", rel_sat="RelationshipSatisfaction", balance="WorkLifeBalance",
    travel_frequent="Travel_Frequently", travel_rare="Travel_Rarely", single="Single",
    categoricals=HR_CATEGORICALS, numerics=HR_NUMERICS,
)

# Binding of the same roles on the fact view (see sources.tables.fact_frame).
FACT_CATEGORICALS = ("dept", "role", "gender", "marital", "education_field", "travel", "overtime")
FACT_NUMERICS = ("age", "income", "level", "experience", "tenure", "role_years", "job_sat", "env_sat",
                 "rel_sat", "balance", "rate1")
# numeric columns profiled in the exploratory analyses: the model features plus the constant column
FACT_EDA_NUMERICS = FACT_NUMERICS + ("constant_col",)

FACT_ROLES = Roles(
    outcome="outcome", label="y", positive="Yes", negative="No", row_id="row_id",
    dept="dept", role="role", gender="gender", marital="marital", education_field="education_field",
    travel="travel", overtime="overtime", age="age", income="income", level="level",
    experience="experience", tenure="tenure", role_years="role_years", job_sat="job_sat",
    env_sat="env_sat", rel_sat="rel_sat", balance="balance",
    travel_frequent="1-URGENT", travel_rare="2-HIGH", single="BUILDING",
    categoricals=FACT_CATEGORICALS, numerics=FACT_NUMERICS,
)
