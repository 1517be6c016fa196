"""Ids, names and rates the operators compare against, as one immutable object.

No operator holds a literal id: another chain passes its own ``Settings``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Must equal the source system's codes and names.
HEAD_OFFICE_SUBDIVS = (
    "000000002", "000000025", "000000027", "000000029", "000000031", "000000037",
    "000000088", "000000091", "000000124", "000000128", "000000131", "000000143",
    "000000146", "000000147", "000000158", "000000161", "000000163", "000000164",
    "000000165", "000000166", "000000205", "000000206", "000000209", "000000210",
    "000000215", "000000216", "000000230", "000000236", "000000244", "000000249",
)
DROPPED_EXPENSES = (
    "53 Курсові різниці",
    "44 Спонсорська/матеріальна допомога",
    "43 Капітальні інвестиції",
    "41 Ремонти",
)
UTILITY_EXPENSES = ("04 Комунальні послуги", "091 Генератори, інш оствітл та обладнання")
RENT_EXPENSE = "02 Орендна плата"
FUEL_EXPENSE = "09 Витрати на пальне"
MAINTENANCE_EXPENSES = (
    "08 Автовитрати, запчастини", "231 Оформлення документів", "24 Страхування",
)
NON_DIRECT_EXPENSES = (
    "00 Заробітна плата",
    "02 Орендна плата",
    "04 Комунальні послуги",
    "091 Генератори, інш оствітл та обладнання",
    "08 Автовитрати, запчастини",
    "09 Витрати на пальне",
)
SUPPORT_EXPENSE = "Комунальні послуги - з/п персоналу"
SUPERMARKET_B2C = " Супермаркети  В2С"
SUPERMARKET_B2B = " Супермаркети  В2В"
TRADE_CATEGORIES = ("Міні", "Міді", "Максі", "Супер")
DISCOUNT_ROUNDING = "Округление на вид оплаты"
DISCOUNT_EARNED_NAME = "5% на бонусний рахунок"
DISCOUNT_SPENT_NAME = "Використання бонусів"
DISCOUNT_EARNED = "Нарахування_бонусів"
DISCOUNT_SPENT = "Використання_бонусів"
DISCOUNT_MARKETING = "Знижка_Маркетинг"
DISCOUNT_CLASSES = (DISCOUNT_EARNED, DISCOUNT_SPENT, DISCOUNT_MARKETING)
NAME_CLEANING = (
    ("ТоргівельнийЦентр", "ТЦ"),
    ("[Р|р]оздріб", ""),
    ("Кам'янець-Подільський", "Кам-Под"),
)


@dataclass(frozen=True)
class Settings:
    """Defaults are the fixed values of the source system."""

    # windows
    months_back: int = 3
    months_back_long: int = 12
    inventory_months: int = 3
    motion_months: int = 3
    # organisations and subdivisions
    main_organization: str = "000000001"
    subdiv_merge: dict = field(default_factory=lambda: {"000000189": "000000007"})
    expense_subdiv_merge: dict = field(default_factory=lambda: {
        "000000189": "000000007", "000000251": "000000190", "000000256": "000000257"})
    head_office: tuple = HEAD_OFFICE_SUBDIVS
    head_office_target: str = "000000001"
    rent_subdiv_merge: dict = field(default_factory=lambda: {"000000227": "000000225"})
    service_subdiv_merge: dict = field(default_factory=lambda: {"000000236": "000000168"})
    logistic_subdivs: tuple = ("000000004", "000000197")
    # sales
    excluded_check_items: tuple = ("000532240",)
    excluded_structure_categories: tuple = ("000000013",)
    # expenses
    excluded_expense_id: str = "100000421"
    # payroll
    retail_positions: tuple = (
        "000000031", "000000032", "000000033", "000000043", "000000187",
        "000000203", "000000012")
    support_positions: tuple = ("000000036", "000000049")
    driver_positions: tuple = ("000000041", "000000039")
    manager_position: str = "000000031"
    manager_share: float = 0.15
    no_manager_subdivs: tuple = ("000000140",)
    compensation_kind: str = "00019"
    tax_kind: str = "00014"
    compensation_extra_rate: float = 0.195
    # ledger
    vat_account: str = "6412"
    # warehouses
    main_store: str = "000000001"
    main_store_subdiv: str = "000000004"
    satellite_store: str = "000001073"
    satellite_subdiv: str = "000000197"
    accumulator_subdivs: dict = field(default_factory=lambda: {
        "000001064": "000000139", "000001098": "000000225"})
    closed_parent_stores: tuple = ("000001096", "000001084")
    non_trade_roots: tuple = ("000500558", "000300000", "000400010")
    # delivery
    excluded_directions: tuple = ("САМОВИВІЗ", "Закриття документів")
    excluded_routes: tuple = ("000000106",)
    excluded_vehicles: tuple = ("000000035",)
    extra_delivery: tuple = (("000000022", "000001110"),)
    excluded_delivery: tuple = (("000001073", "000001111"), ("000000001", "000001110"))
    half_distance_routes: tuple = ("000000002",)
    extra_transport_subdiv: str = "000000246"
    min_return_date: date = date(2001, 1, 1)
    last_unset_year: int = 21
    # prices, categories, areas
    price_type: str = "000000005"
    category_names: dict = field(default_factory=lambda: {
        "000000003": "07. Приладдя д/письма",
        "000000005": "06. Усп.керівник",
        "000000011": "04. Прибирання, кава",
        "000000020": "16. Лайфстайл"})
    area_types: tuple = ("total_area", "trade_area", "storage", "b2b_area", "copycenter_area")
    subdiv_property: str = "000000191"
    supermarket_b2c: str = SUPERMARKET_B2C
    supermarket_b2b: str = SUPERMARKET_B2B
    # KPI rates and thresholds
    overhead_rate: float = 0.05
    class_bounds: tuple = (60, 100)
    share_threshold: float = 0.8
    price_growth: float = 1.05
