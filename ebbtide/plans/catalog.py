"""Feature catalogues: which metrics the client, hotel and monthly tables aggregate, and how.

The upstream client table also carries two case counters named after the operator's own brand; pass
them (or any other counters) as ``extra`` to get their columns too.
"""

from __future__ import annotations

from collections.abc import Sequence

from ebbtide.plans.spec import Fn, Line, line

# Column names and window lengths that the input tables and scored models rely on.
SLOT_LENGTHS = (1, 2, 3, 4, 13)
MONTH_LENGTHS = (1, 12)
SETTLEMENT_LENGTHS = (6, 13)

CLIENT_TRADING = """
rn gross_sales one_om booking_dates
""".split()

CLIENT_ACTIVITY = """
searches_total valuations_total bookings_total bookingcancellation searches_failed valuations_failed
bookings_failed
""".split()

CLIENT_CASES = """
bookings_with_cases_ops bookings_with_cases_sales bookings_with_cases_finance bookout
cases_finance_reason_fm cases_finance_status_solved cases_ops_status_solved cases_ops_status_noproceed
cases_sales_status_solved
bookingcancellationandorwaiverrequest bookingnotfoundorbookingdiscrepancies bookingpaidatdestination
bookingstatusandbookingreconfirmation breachofcontract businessmodelcommission cancellation clientnoshow
commercialactionsgestures commercialrequestsupport compensationissues connectivity contenterror
contentweberrororsystemfailure contracterror contractunification creation creditcardfraudccf
creditcontrol dissatisfaction doesnotcorrespondtoagency doublechargeserroneouscharges duplicatedinvoice
feesnegotiationrequired feesnegotiationrequested fraudbookings fraudulentagencyfag fraudulentbooking
hotelincidentduringstay hotelchangeterminaltoterminaltransfer hotelclosed inflightservice
inconveniencesduringrentacarpickupreturn inconveniencesduringticketpickup
inconveniencesduringticketutilization massiveoverselling noshow overbooking paymentissue prepayment
pricematch ratediscrepancy ratedisputeorreservationcontracterror ratesandfees requestvalidcreditcard
resendvoucher reservationerrorornotfound returnoperationproblem salessupportwebcredentials
servicedescriptioninnacurate servicenotprovided stopsales systemissue weberrorsystemfailure groups
extras hotel_contract accomocation compensation transfer circuits totality_service excursions
specialist_tours
""".split()

CLIENT_CALL_SUMS = """
calls_num_on_hold_cases calls_num_closed_cases calls_num_other_cases calls_total_num_cases
""".split()

MONTH_RESOLUTIONS = """
res_ghost_bookings res_breach_of_contract res_building_works res_connectivity res_force_majeure
res_hotel_closure res_overbooking_overselling res_payment_issue res_system_issue
res_contract_unification res_refundable res_non_refundable res_agent_mistake res_booking_maximization
res_cancellation_fees res_bankruptcy res_customer_complaint res_commercial_gesture res_contract_error
res_debt_writeoff res_denied_bookings res_fraudulent_bookings res_grace_period res_guarantees
res_mapping_error res_no_show res_pink_booking res_stop_sales res_btb res_vacation_rental
res_requested_by_client res_bco res_canrec res_change_of_currency res_change_of_taxes
res_b2b_configuration res_uncatalogued res_cancellation res_tax_adjustment res_massive_overselling
res_other_modifications res_system_decommissioning res_crc res_fraud res_dsweb_out_of_scope
res_old_bookings res_amendment_by_client res_ds_out_of_scope res_legacy_system
""".split()

HOTEL_TRADING = """
rn gross_sales one_om gross_commercial_cost pax booking_dates
""".split()

HOTEL_ATTRIBUTES = """
has_contracts_to_future has_some_gnd has_gnd segmentation hotel_destination_segment region
hotel_total_rooms days_to_date_from_gnd days_to_date_to_gnd days_to_max_arrival_date
""".split()

HOTEL_SETTLEMENTS = """
churn_2m churn_3m churn_4m churn_5m churn_more_5m
""".split()

# The variables the client model is scored on.
CLIENT_MODEL_FEATURES = """
FF_AMOUNT_OVERRIDE_EUR_SUM_L1S FF_CALLS_AVG_CASE_AGING_MEAN_L13S FF_GROSS_SALES_SUM_L13S
FF_GROSS_SALES_SUM_L1S FF_ONE_OM_SUM_L13S FF_ONE_OM_SUM_L1S FF_MARKUP_MEAN_L13S
FF_BOOKINGCANCELLATION_SUM_L13S FF_VALUATIONS_TOTAL_SUM_L13S FF_SEARCHES_TOTAL_SUM_L13S
FF_SEARCHES_TOTAL_SUM_L1S
""".split()

# Always kept by the hotel model next to the selected variables.
HOTEL_FORCED_FEATURES = ["FF_REGION_MAX_L1S", "FF_HOTEL_CATEGORY_GROUP_MAX_L1S"]

# Numerator and denominator of the proportional variables.
RATIO_PAIRS = {
    "BOOKINGCANCELLATION_L1M": "GROSS_SALES_L1M",
    "BOOKINGS_WITH_CASES_OPS_L1M": "GROSS_SALES_L1M",
    "BOOKINGS_WITH_CASES_SALES_L1M": "GROSS_SALES_L1M",
    "BOOKINGS_WITH_CASES_FINANCE_L1M": "GROSS_SALES_L1M",
    "BOOKOUT_L1M": "GROSS_SALES_L1M",
    "CALLS_TOTAL_NUM_CASES_L1M": "GROSS_SALES_L1M",
    "SEARCHES_FAILED_L1M": "SEARCHES_TOTAL_L1M",
    "BOOKINGCANCELLATION_L12M": "GROSS_SALES_L12M",
    "BOOKINGS_WITH_CASES_OPS_L12M": "GROSS_SALES_L12M",
    "BOOKINGS_WITH_CASES_SALES_L12M": "GROSS_SALES_L12M",
    "BOOKINGS_WITH_CASES_FINANCE_L12M": "GROSS_SALES_L12M",
    "BOOKOUT_L12M": "GROSS_SALES_L12M",
    "CALLS_TOTAL_NUM_CASES_L12M": "GROSS_SALES_L12M",
    "VALUATIONS_TOTAL_L12M": "SEARCHES_TOTAL_L12M",
    "SEARCHES_FAILED_L12M": "SEARCHES_TOTAL_L12M",
}

TARGET_METRIC = {"HOTEL": "GROSS_COMMERCIAL_COST", "CLIENT": "GROSS_SALES"}
INACTIVE_BELOW = 0.005


def _sums(metrics: Sequence[str], lengths: Sequence[int], mode: str = "agg") -> list[Line]:
    return [line(name, Fn.SUM, lengths, mode) for name in metrics]


def _means(metrics: Sequence[str], lengths: Sequence[int], mode: str = "agg") -> list[Line]:
    return [line(name, Fn.AVG, lengths, mode) for name in metrics]


def _peaks(metrics: Sequence[str], lengths: Sequence[int], mode: str = "agg") -> list[Line]:
    return [line(name, Fn.MAX, lengths, mode) for name in metrics]


def _recency(lengths: Sequence[int]) -> list[Line]:
    return [
        line("min_booking_date", [Fn.ISNULL, Fn.DIFF_DATE_MIN], lengths),
        line("max_booking_date", [Fn.ISNULL, Fn.DIFF_DATE_MAX], lengths),
    ]


def _calls(lengths: Sequence[int]) -> list[Line]:
    return [
        *_sums(CLIENT_CALL_SUMS, lengths),
        *_means(["calls_avg_case_aging", "calls_avg_fcr"], lengths),
        *_sums(["calls_avg_answer_time", "calls_sum_calls", "calls_sum_attended"], lengths),
        *_means(["calls_avg_sla"], lengths),
        *_sums(["calls_sum_avrg_aht"], lengths),
    ]


def client_lines(lengths: Sequence[int] = SLOT_LENGTHS, extra: Sequence[str] = ()) -> list[Line]:
    """Feature lines of the client table."""
    return [
        *_sums(CLIENT_TRADING, lengths),
        *_recency(lengths),
        *_sums([*CLIENT_ACTIVITY, *CLIENT_CASES, *extra], lengths),
        *_sums(["amount_override_eur"], lengths),
        *_means(["markup", "channel_markup"], lengths),
        *_calls(lengths),
    ]


def hotel_lines(lengths: Sequence[int] = SLOT_LENGTHS) -> list[Line]:
    """Feature lines of the hotel table: cumulative windows, single-slot windows and attributes."""
    both = ("agg", "only")
    demand = ["searches", "valuations", "searches_1_hotel", "times_returned_1_hotel"]
    return [
        *_sums(HOTEL_TRADING, lengths),
        *[item for mode in both for item in _means(["markup", "cpt_all"], lengths, mode)],
        *_means(["cpt_p"], lengths),
        *[item for mode in both for item in _sums(demand, lengths, mode)],
        *_sums(["maxirooms_events"], lengths),
        *_recency(lengths),
        *[item for mode in both for item in _peaks(["ratemix"], lengths, mode)],
        *_peaks(["hotel_category_group", *HOTEL_ATTRIBUTES], [1]),
        *_sums(["gross_commercial_cost_next_slot"], [1]),
        *_sums(HOTEL_SETTLEMENTS, SETTLEMENT_LENGTHS),
    ]


def month_lines(lengths: Sequence[int] = MONTH_LENGTHS, extra: Sequence[str] = ()) -> list[Line]:
    """Feature lines of the calendar-month table."""
    return [
        *_sums(["rn", "gross_sales", "booking_dates"], lengths),
        *_recency(lengths),
        *_sums([*CLIENT_ACTIVITY, *CLIENT_CASES, *extra], lengths),
        *_peaks(["has_override"], lengths),
        *_sums(["amount_override_eur"], lengths),
        *_peaks(["override_triggered"], lengths),
        *_means(["markup", "channel_markup"], lengths),
        *_peaks(["payment_credit", "payment_prepayment"], lengths),
        *_sums(MONTH_RESOLUTIONS, lengths),
        *_calls(lengths),
    ]
