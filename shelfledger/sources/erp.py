"""Where the source system keeps the logical tables: physical table, columns (``new -> old``) and flags, stored as one byte."""

from __future__ import annotations

# Table and column names of the source system.
TABLES = {
    "subdiv_dim": {
        "table": "_Reference135",
        "columns": {
            "ref": "_IDRRef", "subdiv_id": "_Code", "subdiv_name": "_Description", "parent_ref": "_ParentIDRRef",
            "store_ref": "_Fld18502RRef", "marked": "_Marked",
        },
        "flags": ["marked"],
    },
    "store_dim": {
        "table": "_Reference156",
        "columns": {
            "ref": "_IDRRef", "store_id": "_Code", "store_name": "_Description", "store_location": "_Fld2312",
            "subdiv_ref": "_Fld2296RRef", "distribution_ref": "_Fld19506RRef", "parent_ref": "_ParentIDRRef",
            "marked": "_Marked",
        },
        "flags": ["marked"],
    },
    "item_dim": {
        "table": "_Reference120",
        "columns": {
            "ref": "_IDRRef", "item_id": "_Code", "item_name": "_Description", "pack_qty": "_Fld20858",
            "price_group_ref": "_Fld2060RRef", "group_ref": "_Fld2045RRef", "parent_ref": "_ParentIDRRef",
            "unit_ref": "_Fld2039RRef", "is_tva": "_Fld2068", "item_marked": "_Marked",
        },
        "flags": ["is_tva", "item_marked"],
    },
    "price_group_dim": {
        "table": "_Reference235",
        "columns": {
            "ref": "_IDRRef", "price_group": "_Description",
        },
        "flags": [],
    },
    "group_dim": {
        "table": "_Reference122",
        "columns": {
            "ref": "_IDRRef", "group_id": "_Code", "group_name": "_Description", "category_ref": "_Fld19599RRef",
            "parent_ref": "_ParentIDRRef", "group_marked": "_Marked",
        },
        "flags": ["group_marked"],
    },
    "category_dim": {
        "table": "_Reference19598",
        "columns": {
            "ref": "_IDRRef", "category_id": "_Code", "category_name": "_Description", "is_marked": "_Marked",
        },
        "flags": ["is_marked"],
    },
    "unit_dim": {
        "table": "_Reference84",
        "columns": {
            "ref": "_IDRRef", "width": "_Fld18500", "height": "_Fld18501", "depth": "_Fld18499",
            "weight": "_Fld1642", "volume": "_Fld1643",
        },
        "flags": [],
    },
    "organization_dim": {
        "table": "_Reference128",
        "columns": {
            "ref": "_IDRRef", "organization_id": "_Code",
        },
        "flags": [],
    },
    "project_dim": {
        "table": "_Reference143",
        "columns": {
            "ref": "_IDRRef", "project_id": "_Code", "project": "_Description",
        },
        "flags": [],
    },
    "region_dim": {
        "table": "_Reference149",
        "columns": {
            "ref": "_IDRRef", "region_id": "_Code",
        },
        "flags": [],
    },
    "locality_dim": {
        "table": "_Reference199",
        "columns": {
            "ref": "_IDRRef", "locality_id": "_Code",
        },
        "flags": [],
    },
    "partner_dim": {
        "table": "_Reference102",
        "columns": {
            "ref": "_IDRRef", "customer_id": "_Code",
        },
        "flags": [],
    },
    "address_dim": {
        "table": "_Reference194",
        "columns": {
            "ref": "_IDRRef", "deliv_address_id": "_Code", "marked": "_Marked", "is_main": "_Fld2740",
            "owner_ref": "_OwnerID_RRRef", "locality_ref": "_Fld18128RRef", "region_ref": "_Fld2738RRef",
            "lat": "_Fld24538", "long": "_Fld24539",
        },
        "flags": ["marked", "is_main"],
    },
    "area_register": {
        "table": "_InfoRg22018",
        "columns": {
            "date": "_Period", "active": "_Active", "subdiv_ref": "_Fld22019RRef", "type_ref": "_Fld22020RRef",
            "area_value": "_Fld22021",
        },
        "flags": ["active"],
    },
    "area_type": {
        "table": "_Enum22007",
        "columns": {
            "ref": "_IDRRef", "enum_order": "_EnumOrder",
        },
        "flags": [],
    },
    "expense_item": {
        "table": "_Reference169",
        "columns": {
            "ref": "_IDRRef", "id": "_Code", "name": "_Description", "parent_ref": "_ParentIDRRef",
            "marked": "_Marked",
        },
        "flags": ["marked"],
    },
    "route_dim": {
        "table": "_Reference19642",
        "columns": {
            "ref": "_IDRRef", "route_id": "_Code", "route": "_Description", "parent_ref": "_ParentIDRRef",
            "subdiv_ref": "_Fld19647RRef", "route_marked": "_Marked",
        },
        "flags": ["route_marked"],
    },
    "route_region": {
        "table": "_Reference19642_VT19654",
        "columns": {
            "route_ref": "_Reference19642_IDRRef", "region_ref": "_Fld19656RRef",
        },
        "flags": [],
    },
    "vehicle_dim": {
        "table": "_Reference195",
        "columns": {
            "ref": "_IDRRef", "auto_id": "_Code", "auto_name": "_Description", "is_cargo": "_Fld21584",
            "marked": "_Marked", "subdiv_ref": "_Fld19665RRef", "store_ref": "_Fld19668RRef", "tank": "_Fld21651",
            "load_capacity": "_Fld19666", "volume": "_Fld19667",
        },
        "flags": ["is_cargo", "marked"],
    },
    "property_value": {
        "table": "_InfoRg14478",
        "columns": {
            "object_ref": "_Fld14479_RRRef", "property_ref": "_Fld14480RRef", "value_ref": "_Fld14481_RRRef",
        },
        "flags": [],
    },
    "property_kind": {
        "table": "_Chrc806",
        "columns": {
            "ref": "_IDRRef", "code": "_Code",
        },
        "flags": [],
    },
    "property_name": {
        "table": "_Reference85",
        "columns": {
            "ref": "_IDRRef", "name": "_Description",
        },
        "flags": [],
    },
    "direction_dim": {
        "table": "_Reference193",
        "columns": {
            "ref": "_IDRRef", "direction": "_Description",
        },
        "flags": [],
    },
    "scenario_dim": {
        "table": "_Reference178",
        "columns": {
            "ref": "_IDRRef", "script_name": "_Description",
        },
        "flags": [],
    },
    "account_dim": {
        "table": "_Acc18",
        "columns": {
            "ref": "_IDRRef", "acc_id": "_Code",
        },
        "flags": [],
    },
    "price_type_dim": {
        "table": "_Reference183",
        "columns": {
            "ref": "_IDRRef", "price_type_id": "_Code",
        },
        "flags": [],
    },
    "check_report": {
        "table": "_Document329",
        "columns": {
            "ref": "_IDRRef", "posted": "_Posted", "is_managerial": "_Fld7964", "date": "_Date_Time",
            "nmbr_checks_report": "_Number", "organization_ref": "_Fld7962RRef", "subdiv_ref": "_Fld7966RRef",
        },
        "flags": ["posted", "is_managerial"],
    },
    "check_line": {
        "table": "_Document329_VT7992",
        "columns": {
            "report_ref": "_Document329_IDRRef", "check_nmbr": "_Fld8019", "check_time": "_Fld8020",
            "item_ref": "_Fld7994RRef", "item_qty": "_Fld7998", "item_sum": "_Fld7999",
        },
        "flags": [],
    },
    "check_regular": {
        "table": "_Document329_VT8066",
        "columns": {
            "report_ref": "_Document329_IDRRef", "reg_cust_sum": "_Fld8070",
        },
        "flags": [],
    },
    "cost_register": {
        "table": "_AccumRg17487",
        "columns": {
            "date": "_Period", "active": "_Active", "subdiv_ref": "_Fld17492RRef", "project_ref": "_Fld17493RRef",
            "doc_ref": "_RecorderRRef", "item_ref": "_Fld17488RRef", "item_qty": "_Fld17494",
            "item_cost_sum": "_Fld17495", "item_cost_vat": "_Fld17496",
        },
        "flags": ["active"],
    },
    "sale_register": {
        "table": "_AccumRg17435",
        "columns": {
            "date": "_Period", "active": "_Active", "subdiv_ref": "_Fld17441RRef",
            "organization_ref": "_Fld17443RRef", "sale_doc_ref": "_Fld17440_RRRef",
            "cust_order_ref": "_Fld17438_RRRef", "item_ref": "_Fld17436RRef", "project_ref": "_Fld17442RRef",
            "item_qty": "_Fld17445", "item_sum": "_Fld17446", "item_vat": "_Fld17448",
        },
        "flags": ["active"],
    },
    "sale_doc": {
        "table": "_Document375",
        "columns": {
            "ref": "_IDRRef", "sale_doc_nmbr": "_Number", "sale_doc_date": "_Date_Time",
            "customer_ref": "_Fld10909RRef", "subdiv_ref": "_Fld10904RRef",
        },
        "flags": [],
    },
    "refund_doc": {
        "table": "_Document251",
        "columns": {
            "ref": "_IDRRef", "posted": "_Posted", "is_managerial": "_Fld3903", "nmbr_refund_doc": "_Number",
            "date_refund_doc": "_Date_Time",
        },
        "flags": ["posted", "is_managerial"],
    },
    "refund_line": {
        "table": "_Document251_VT3939",
        "columns": {
            "refund_ref": "_Document251_IDRRef", "item_ref": "_Fld3941RRef", "item_qty": "_Fld3942",
            "sale_doc_ref": "_Fld3953_RRRef",
        },
        "flags": [],
    },
    "sale_plan": {
        "table": "_Document350",
        "columns": {
            "ref": "_IDRRef", "posted": "_Posted", "date": "_Fld8946", "subdiv_ref": "_Fld8951RRef",
            "project_ref": "_Fld8952RRef", "script_ref": "_Fld8953RRef", "sum": "_Fld8954",
        },
        "flags": ["posted"],
    },
    "expense_register": {
        "table": "_AccumRg17131",
        "columns": {
            "date": "_Period", "active": "_Active", "type_exp": "_RecordKind", "subdiv_ref": "_Fld17132RRef",
            "exp_item_ref": "_Fld17133RRef", "project_ref": "_Fld21330RRef", "exp_sum": "_Fld17136",
            "exp_vat": "_Fld17137",
        },
        "flags": ["active"],
    },
    "payroll_doc": {
        "table": "_Document312",
        "columns": {
            "ref": "_IDRRef", "date": "_Date_Time", "posted": "_Posted", "period_reg": "_Fld6706",
            "is_managerial": "_Fld6712",
        },
        "flags": ["posted", "is_managerial"],
    },
    "payroll_line": {
        "table": "_Document312_VT6743",
        "columns": {
            "doc_ref": "_Document312_IDRRef", "employee_ref": "_Fld6745RRef", "position_ref": "_Fld18155RRef",
            "subdiv_ref": "_Fld6763RRef", "salary": "_Fld6753", "working_hours": "_Fld6756",
            "norm_hours": "_Fld6758",
        },
        "flags": [],
    },
    "contribution_line": {
        "table": "_Document312_VT7084",
        "columns": {
            "doc_ref": "_Document312_IDRRef", "employee_ref": "_Fld7086RRef", "sum": "_Fld7096",
        },
        "flags": [],
    },
    "tax_line": {
        "table": "_Document312_VT7114",
        "columns": {
            "doc_ref": "_Document312_IDRRef", "employee_ref": "_Fld7116RRef", "sum": "_Fld7119",
        },
        "flags": [],
    },
    "employee_dim": {
        "table": "_Reference159",
        "columns": {
            "ref": "_IDRRef", "organization_ref": "_Fld2324RRef", "individ_ref": "_Fld2322RRef",
        },
        "flags": [],
    },
    "individual_dim": {
        "table": "_Reference191",
        "columns": {
            "ref": "_IDRRef", "individ_id": "_Code",
        },
        "flags": [],
    },
    "position_dim": {
        "table": "_Reference81",
        "columns": {
            "ref": "_IDRRef", "position_id": "_Code",
        },
        "flags": [],
    },
    "position_history": {
        "table": "_InfoRg15330",
        "columns": {
            "date_rec": "_Period", "individ_ref": "_Fld15331RRef", "subdiv_ref": "_Fld15332RRef",
            "position_ref": "_Fld15333RRef",
        },
        "flags": [],
    },
    "charge": {
        "table": "_Crg1030",
        "columns": {
            "date": "_Period", "is_active": "_Active", "employee_ref": "_Fld1032RRef", "kind_ref": "_CalcKindRRef",
            "organization_ref": "_Fld1031RRef", "compensation_sum": "_Fld1036", "subdiv_ref": "_Fld1058RRef",
        },
        "flags": ["is_active"],
    },
    "charge_kind": {
        "table": "_CKinds8",
        "columns": {
            "ref": "_IDRRef", "code": "_Code",
        },
        "flags": [],
    },
    "tax_rate": {
        "table": "_Crg993",
        "columns": {
            "date": "_Period", "is_active": "_Active", "employee_ref": "_Fld995RRef",
            "organization_ref": "_Fld994RRef", "kind_ref": "_CalcKindRRef", "tax_rate": "_Fld1007",
        },
        "flags": ["is_active"],
    },
    "tax_kind": {
        "table": "_CKinds7",
        "columns": {
            "ref": "_IDRRef", "code": "_Code",
        },
        "flags": [],
    },
    "ledger": {
        "table": "_AccRg855",
        "columns": {
            "date": "_Period", "active": "_Active", "account_dt_ref": "_AccountDtRRef",
            "account_ct_ref": "_AccountCtRRef", "organization_ref": "_Fld856RRef", "moving_sum": "_Fld859",
        },
        "flags": ["active"],
    },
    "stock_movement": {
        "table": "_AccumRg17702",
        "columns": {
            "date_movement": "_Period", "active": "_Active", "recorder_ref": "_RecorderRRef",
            "store_ref": "_Fld17703RRef", "item_ref": "_Fld17704RRef", "type_motion": "_RecordKind",
            "item_motion_qty": "_Fld17708",
        },
        "flags": ["active"],
    },
    "batch_movement": {
        "table": "_AccumRg17286",
        "columns": {
            "date_movement": "_Period", "active": "_Active", "store_ref": "_Fld17288RRef",
            "item_ref": "_Fld17287RRef", "type_motion": "_RecordKind", "item_motion_qty": "_Fld17295",
            "item_store_sum": "_Fld17296", "item_store_vat": "_Fld17297", "receipt_doc_ref": "_Fld17291_RRRef",
        },
        "flags": ["active"],
    },
    "stock_balance": {
        "table": "_AccumRgT17710",
        "columns": {
            "date_balance": "_Period", "store_ref": "_Fld17703RRef", "item_ref": "_Fld17704RRef",
            "item_store_qty": "_Fld17708",
        },
        "flags": [],
    },
    "batch_balance": {
        "table": "_AccumRgT17307",
        "columns": {
            "date_balance": "_Period", "store_ref": "_Fld17288RRef", "item_ref": "_Fld17287RRef",
            "item_store_qty": "_Fld17295", "item_store_sum": "_Fld17296", "item_store_vat": "_Fld17297",
            "receipt_doc_ref": "_Fld17291_RRRef",
        },
        "flags": [],
    },
    "receipt_doc": {
        "table": "_Document360",
        "columns": {
            "ref": "_IDRRef", "date": "_Date_Time",
        },
        "flags": [],
    },
    "assembly_doc": {
        "table": "_Document298",
        "columns": {
            "ref": "_IDRRef", "date": "_Date_Time",
        },
        "flags": [],
    },
    "price_history": {
        "table": "_InfoRg16225",
        "columns": {
            "date_setting": "_Period", "price_type_ref": "_Fld16226RRef", "item_ref": "_Fld16227RRef",
            "active": "_Active", "item_price": "_Fld16230",
        },
        "flags": ["active"],
    },
    "transfer_out": {
        "table": "_Document411",
        "columns": {
            "ref": "_IDRRef", "nmbr": "_Number", "date": "_Date_Time", "receiver_store_ref": "_Fld12657RRef",
        },
        "flags": [],
    },
    "trip": {
        "table": "_Document416",
        "columns": {
            "ref": "_IDRRef", "posted": "_Posted", "nmbr_delivery": "_Number", "date_delivery": "_Date_Time",
            "store_ref": "_Fld12841RRef", "time_depart": "_Fld12837", "time_return": "_Fld12838",
            "direction_ref": "_Fld12831RRef", "route_ref": "_Fld19689RRef", "vehicle_ref": "_Fld12834RRef",
            "delivery_weight": "_Fld12830", "speedo_start": "_Fld12835", "speedo_finish": "_Fld12836",
        },
        "flags": ["posted"],
    },
    "trip_forwarder": {
        "table": "_Document416_VT12850",
        "columns": {
            "trip_ref": "_Document416_IDRRef", "individ_ref": "_Fld12852RRef",
        },
        "flags": [],
    },
    "trip_driver": {
        "table": "_Document416_VT12853",
        "columns": {
            "trip_ref": "_Document416_IDRRef", "individ_ref": "_Fld12855RRef",
        },
        "flags": [],
    },
    "trip_order": {
        "table": "_Document416_VT12842",
        "columns": {
            "trip_ref": "_Document416_IDRRef", "order_ref": "_Fld12844_RRRef", "to_intermediate": "_Fld12845",
            "is_not_delivered": "_Fld12846",
        },
        "flags": ["to_intermediate", "is_not_delivered"],
    },
    "delivery_order": {
        "table": "_Document409",
        "columns": {
            "ref": "_IDRRef", "posted": "_Posted", "nmbr_deliv_order": "_Number", "date_deliv_order": "_Date_Time",
            "weight": "_Fld12605", "store_ref": "_Fld12588_RRRef", "address_ref": "_Fld12593RRef",
            "recipient_ref": "_Fld12590_RRRef", "intermediate_ref": "_Fld12589RRef", "declaration": "_Fld21329",
            "base_doc_ref": "_Fld12587_RRRef",
        },
        "flags": ["posted"],
    },
    "luggage_note": {
        "table": "_Document417",
        "columns": {
            "ref": "_IDRRef", "nmbr": "_Number", "date": "_Date_Time",
        },
        "flags": [],
    },
    "delivery_schedule": {
        "table": "_InfoRg18903",
        "columns": {
            "date": "_Period", "recipient_ref": "_Fld18946RRef", "distribution_ref": "_Fld18944RRef",
            "day_1": "_Fld19445", "day_2": "_Fld19446", "day_3": "_Fld19447", "day_4": "_Fld19448",
            "day_5": "_Fld19449", "day_6": "_Fld19450", "day_7": "_Fld19451",
        },
        "flags": ["day_1", "day_2", "day_3", "day_4", "day_5", "day_6", "day_7"],
    },
}
# The point-of-sale database has plain names; its tables are read as they are.
POS_TABLES = {
    "receipt_header": "trm_out_receipt_header",
    "receipt_discounts": "trm_out_receipt_discounts",
    "receipt_footer": "trm_out_receipt_footer",
    "receipt_item": "trm_out_receipt_item",
    "receipt_item_discount": "trm_out_receipt_item_discount",
    "pos": "trm_in_pos",
    "pos_store": "trm_in_store",
}


def mapping() -> dict[str, dict]:
    """Physical table, columns (``new -> old``) and flags of every logical table, for ``MappedTables``."""
    return {name: {"table": e["table"], "columns": dict(e["columns"]), "flags": list(e["flags"])} for name, e in TABLES.items()}
