"""Canonical tables of final accounts and budgets, by key.

All are texts that reports themselves print; they are listed as they stand.
"""

from __future__ import annotations

#: nine tables of final accounts: name, aliases
FINAL_TABLES = {
    "T1": ("收入支出决算总表", "部门收支决算总表", "收支决算总表"),
    "T2": ("收入决算表", "部门收入决算表"),
    "T3": ("支出决算表", "部门支出决算表"),
    "T4": ("财政拨款收入支出决算总表", "财政拨款收支决算总表"),
    "T5": ("一般公共预算财政拨款支出决算表", "一般公共预算支出决算表"),
    "T6": ("一般公共预算财政拨款基本支出决算表", "基本支出决算表"),
    "T7": ("一般公共预算财政拨款“三公”经费支出决算表", "财政拨款“三公”经费支出决算表", "三公经费支出决算表", "“三公”经费支出决算表"),
    "T8": ("政府性基金预算财政拨款收入支出决算表", "政府性基金决算表"),
    "T9": ("国有资本经营预算财政拨款收入支出决算表", "国有资本经营预算财政拨款支出决算表", "国有资本经营支出决算表"),
}

#: nine tables of budgets (each also with 部门 or 预算单位 in front)
BUDGET_TABLES = {
    "B1": ("财务收支预算总表",),
    "B2": ("收入预算总表",),
    "B3": ("支出预算总表",),
    "B4": ("财政拨款收支预算总表",),
    "B5": ("一般公共预算支出功能分类预算表",),
    "B6": ("政府性基金预算支出功能分类预算表",),
    "B7": ("国有资本经营预算支出功能分类预算表",),
    "B8": ("一般公共预算基本支出部门预算经济分类预算表",),
    "B9": ("部门“三公”经费和机关运行经费预算表", "单位“三公”经费和机关运行经费预算表", "三公经费和机关运行经费预算表"),
}

#: canonical fact tables: code, classification type, required headers, measures (name, header)
FACT_TABLES = (
    ("FIN_01_income_expenditure_total", "summary", ("本年收入", "本年支出"), (("income_actual", "本年收入"), ("expenditure_actual", "本年支出"), ("beginning_balance", "年初结转和结余"), ("ending_balance", "年末结转和结余"))),
    ("FIN_02_income", "income", ("合计", "财政拨款收入"), (("total_actual", "合计"), ("fiscal_allocation", "财政拨款收入"), ("business_income", "事业收入"), ("operational_income", "经营收入"), ("other_income", "其他收入"))),
    ("FIN_03_expenditure", "expenditure", ("合计", "基本支出", "项目支出"), (("total_actual", "合计"), ("basic_actual", "基本支出"), ("project_actual", "项目支出"), ("to_superior_actual", "上缴上级支出"), ("operational_actual", "经营支出"), ("subsidiary_actual", "对附属单位补助支出"))),
    ("FIN_04_fiscal_grant_total", "summary", ("一般公共预算财政拨款",), (("general_public_budget", "一般公共预算财政拨款"), ("government_fund_budget", "政府性基金预算财政拨款"), ("state_capital_budget", "国有资本经营预算财政拨款"))),
    ("FIN_05_general_public_expenditure", "function", ("合计", "基本支出", "项目支出"), (("total_actual", "合计"), ("basic_actual", "基本支出"), ("project_actual", "项目支出"))),
    ("FIN_06_basic_expenditure", "economic", ("人员经费", "公用经费"), (("total_actual", "合计"), ("personnel_actual", "人员经费"), ("public_actual", "公用经费"))),
    ("FIN_07_three_public", "three_public", ("合计", "因公出国(境)费"), (("budget", "预算数"), ("actual", "决算数"), ("total_actual", "合计"), ("overseas", "因公出国(境)费"), ("vehicle_purchase_operation", "公务用车购置及运行维护费"), ("vehicle_purchase", "公务用车购置费"), ("vehicle_operation", "公务用车运行维护费"), ("reception", "公务接待费"))),
    ("FIN_08_gov_fund", "government_fund", ("合计",), (("total_actual", "合计"), ("basic_actual", "基本支出"), ("project_actual", "项目支出"))),
    ("FIN_09_state_capital", "state_capital", ("合计",), (("total_actual", "合计"), ("basic_actual", "基本支出"), ("project_actual", "项目支出"))),
)

#: fixed values: titles by which each fact table is recognized
FACT_ALIASES = {
    "FIN_01_income_expenditure_total": ("收入支出决算总表", "收入支出总表", "收支决算总表", "收入支出预算总表", "财务收支预算总表", "部门财务收支预算总表", "部门收支预算总表"),
    "FIN_02_income": ("收入决算表", "部门收入决算表", "收入预算总表", "部门收入预算总表"),
    "FIN_03_expenditure": ("支出决算表", "部门支出决算表", "支出预算总表", "部门支出预算总表"),
    "FIN_04_fiscal_grant_total": ("财政拨款收入支出决算总表", "财政拨款收支决算总表", "财政拨款收支预算总表", "部门财政拨款收支预算总表", "财政拨款收入支出预算总表"),
    "FIN_05_general_public_expenditure": ("一般公共预算财政拨款支出决算表", "一般公共预算财政拨款支出表", "一般公共预算支出功能分类预算表", "部门一般公共预算支出功能分类预算表", "一般公共预算支出功能分类表"),
    "FIN_06_basic_expenditure": ("一般公共预算财政拨款基本支出决算表", "基本支出决算明细表", "一般公共预算基本支出部门预算经济分类预算表", "一般公共预算基本支出经济分类预算表", "基本支出部门预算经济分类预算表", "基本支出预算经济分类表"),
    "FIN_07_three_public": ("财政拨款“三公”经费支出决算表", "三公经费支出决算表", "三公经费表", "三公经费和机关运行经费预算表", "部门“三公”经费和机关运行经费预算表"),
    "FIN_08_gov_fund": ("政府性基金预算财政拨款收入支出决算表", "政府性基金预算财政拨款支出决算表", "政府性基金预算支出功能分类预算表", "政府性基金预算财政拨款支出预算表"),
    "FIN_09_state_capital": ("国有资本经营预算财政拨款支出决算表", "国有资本经营预算支出决算表", "国有资本经营预算支出功能分类预算表", "国有资本经营预算财政拨款支出预算表"),
}

#: fixed values: further headers of a measure, beside that of FACT_TABLES
MORE_HEADERS = {
    "FIN_01_income_expenditure_total": {"income_actual": ("本年收入合计", "收入决算数"), "expenditure_actual": ("本年支出合计", "支出决算数"), "beginning_balance": ("上年结转和结余",), "ending_balance": ("结余分配", "使用非财政拨款结余")},
    "FIN_02_income": {"total_actual": ("收入合计", "决算数")},
    "FIN_03_expenditure": {"total_actual": ("支出合计", "决算数")},
    "FIN_05_general_public_expenditure": {"total_actual": ("支出合计", "决算数")},
    "FIN_06_basic_expenditure": {"total_actual": ("决算数",)},
    "FIN_07_three_public": {"budget": ("年初预算数",), "actual": ("支出决算数",), "overseas": ("因公出国（境）费",)},
    "FIN_08_gov_fund": {"total_actual": ("决算数",)},
    "FIN_09_state_capital": {"total_actual": ("决算数",)},
}


def measures(code: str) -> list[tuple[str, str]]:
    """(measure, header) of a fact table, all headers of a measure together."""
    own = next(m for c, _, _, m in FACT_TABLES if c == code)
    return [(name, h) for name, header in own for h in (header, *MORE_HEADERS.get(code, {}).get(name, ()))]


#: tables without which an ingest needs a review
CORE_TABLES = ("FIN_01_income_expenditure_total", "FIN_02_income", "FIN_03_expenditure", "FIN_04_fiscal_grant_total", "FIN_05_general_public_expenditure", "FIN_06_basic_expenditure")


def recognition() -> list[dict]:
    """The dictionary in the form that table recognition takes."""
    return [{"code": code, "aliases": FACT_ALIASES[code], "required": required} for code, _, required, _ in FACT_TABLES]
