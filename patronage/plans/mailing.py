"""The mailing: every stage from the warehouse to the extract.

Stages are DataFrames built on first use.  ``stage_mode`` says how the stages
with several readers are kept (see :func:`patronage.operators.stage.materialize`).
``read_once`` names those that have one reader in this run: they stay in its plan, which then
takes no more of their columns than it needs.
With a ``store`` they are its tables: stages of persons are bucketed by person, so the
extract joins them without an exchange, and a stage with a repeated key stops the run.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import EXTRACT_HEADINGS
from ..functions import money_text, or_empty
from ..operators import contacts, funds, giving, lists, quality, segments
from ..operators.generic import PERSON, pivot_top_n
from ..operators.skew import lookup, merged_lookup, sparse_lookup
from ..operators.stage import NEAR, materialize
from ..operators.store import StageStore
from ..policy import ExtractPolicy
from ..sources import Warehouse

EXTRACT_COLUMNS = tuple(EXTRACT_HEADINGS)
FIGURES_AT_ONCE = 3


class MailingPlan:
    def __init__(
        self,
        warehouse: Warehouse,
        policy: ExtractPolicy = ExtractPolicy(),
        stage_mode: str = "lazy",
        store: StageStore | None = None,
        read_once: Collection[str] = (),
    ):
        self.wh = warehouse
        self.store = store
        self.policy = policy
        self.stage_mode = stage_mode
        self.read_once = read_once

    def _keep(
        self,
        name: str,
        df: DataFrame,
        key: Sequence[str] = (),
        unique: Sequence[str] = (),
    ) -> DataFrame:
        """``key`` is for stages with few rows a key: a store keeps those in buckets.

        Stages in ``NEAR`` are in buckets of columns that may repeat, as tables and in a store alike.
        """
        if self.store is not None:
            return self.store.keep(name, df, key or NEAR.get(name, ()), unique or key)
        return materialize(df, name, "lazy" if name in self.read_once else self.stage_mode)

    def _bucketed(self, name: str, df: DataFrame) -> DataFrame:
        """One row a person, next to the other stages of persons where there is a store."""
        return df if self.store is None else self.store.keep(name, df, [PERSON], [PERSON])

    # --- giving -----------------------------------------------------------

    @cached_property
    def ledger(self) -> DataFrame:
        w = self.wh
        return self._keep(
            "ledger",
            giving.gift_ledger(
                w.comprehensive_giving, w.constituent, w.gift_credit, w.gift, w.gift_type
            ),
        )

    @cached_property
    def lineage(self) -> DataFrame:
        w = self.wh
        return giving.commitment_lineage(w.installment_payment, w.gift, w.calendar)

    @cached_property
    def projections(self) -> DataFrame:
        return giving.projected_gifts(
            self.wh.annual_projection, self.wh.constituent, self.policy.projection
        )

    @cached_property
    def giving(self) -> DataFrame:
        w = self.wh
        return self._keep(
            "giving",
            giving.giving_per_fiscal_year(
                self.ledger,
                w.constituent,
                w.gift,
                w.gift_attribute,
                w.gift_commitment,
                w.recurring_gift,
                w.installment_payment,
                w.calendar,
                self.projections,
                self.policy.giving,
                lineage=self.lineage,
            ),
            [PERSON],
            [PERSON, "fiscal_year"],
        )

    @cached_property
    def annual_years(self) -> DataFrame:
        return self._keep(
            "annual_years", giving.annual_giving_years(self.wh.production), [PERSON], [PERSON, "fiscal_year"]
        )

    @cached_property
    def solicitable(self) -> DataFrame:
        return giving.solicitable_funds(self.wh.fund, self.wh.solicitable_fund)

    @cached_property
    def production_gifts(self) -> DataFrame:
        w = self.wh
        return self._keep(
            "production_gifts",
            giving.production_gifts(
                w.production, w.gift, w.fund, w.appeal, self.solicitable, w.fund_translation
            )
        )

    # --- lists ------------------------------------------------------------

    @cached_property
    def spouse_pairs(self) -> DataFrame:
        return self._keep("spouse_pairs", lists.spouse_pairs(self.wh.constituent))

    @cached_property
    def include_list(self) -> DataFrame:
        return lists.include_list(
            self.giving, self.annual_years, self.wh.primary_code, self.policy.audience
        )

    @cached_property
    def exclude_list(self) -> DataFrame:
        w = self.wh
        return lists.exclude_list(
            w.constituent,
            w.primary_code,
            w.position,
            w.constituent_code,
            w.financial_information,
            w.constituent_attribute,
            w.us_state,
            self.policy.audience,
        )

    @cached_property
    def household_list(self) -> DataFrame:
        return self._keep(
            "household_list",
            lists.household_list(
                self.include_list, self.exclude_list, self.wh.constituent, self.spouse_pairs
            ),
            [PERSON],
        )

    # --- contacts ---------------------------------------------------------

    @cached_property
    def education(self) -> DataFrame:
        w = self.wh
        return self._keep(
            "education",
            contacts.primary_education(
                w.education, w.constituent, w.education_major, w.education_attribute
            ),
            [PERSON],
        )

    @cached_property
    def phones(self) -> DataFrame:
        w = self.wh
        return contacts.reachable(
            contacts.contact_sheet(
                w.constituent, w.address, w.phone, self.policy.home_phone, self.policy.cell_phone
            )
        )

    @cached_property
    def donor_types(self) -> DataFrame:
        return contacts.donor_type(
            self.wh.donor_type, self.wh.constituent, self.policy.donor_type_year
        )

    # --- funds ------------------------------------------------------------

    @cached_property
    def affinity(self) -> DataFrame:
        return funds.fund_affinity(self.production_gifts, self.wh.fund)

    @cached_property
    def rankings(self) -> DataFrame:
        return self._keep("rankings", funds.rank_all(self.affinity))

    @cached_property
    def blend(self) -> DataFrame:
        return funds.points_blend(self.rankings, self.policy.suggestions.points)

    @cached_property
    def eligibility(self) -> DataFrame:
        w = self.wh
        return funds.eligibility(
            w.constituent, self.education, w.education, w.education_attribute, self.spouse_pairs
        )

    @cached_property
    def cascade(self) -> DataFrame:
        return self._keep(
            "cascade",
            funds.rule_cascade(
                self.eligibility,
                self.education,
                self.wh.department_fund,
                self.spouse_pairs,
                self.wh.fund,
                self.policy.suggestions,
            )
        )

    @cached_property
    def control_suggestions(self) -> DataFrame:
        return funds.control_suggestions(
            self.rankings, self.cascade, self.wh.fund, self.policy.suggestions
        )

    @cached_property
    def test_suggestions(self) -> DataFrame:
        return funds.test_suggestions(
            self.blend, self.cascade, self.wh.fund, self.policy.suggestions
        )

    @cached_property
    def control_ranking(self) -> DataFrame:
        return funds.dedupe_and_sequence(
            self.control_suggestions,
            funds.giving_audience(self.giving, self.policy.suggestions.control_years),
        )

    @cached_property
    def final_ranking(self) -> DataFrame:
        return funds.dedupe_and_sequence(
            self.test_suggestions,
            funds.giving_audience(self.giving, self.policy.suggestions.final_years),
        )

    # --- segments ---------------------------------------------------------

    @cached_property
    def segments(self) -> DataFrame:
        return self._keep(
            "segments",
            segments.segment(
                self.household_list,
                self.donor_types,
                self.giving,
                self.annual_years,
                self.policy.segments,
            ),
            [PERSON],
        )

    @cached_property
    def averages(self) -> DataFrame:
        return segments.avg_per_giving_year(self.giving)

    @cached_property
    def asks(self) -> DataFrame:
        return segments.ask_array(
            self.household_list, self.segments, self.averages, self.policy.segments
        )

    # --- gates ------------------------------------------------------------

    @cached_property
    def checks(self) -> list[quality.Check]:
        """Keys of the keyed stages, and of dimensions that lookups rely on."""
        w = self.wh
        keyed = [
            (self.giving, "giving", [PERSON, "fiscal_year"]),
            (self.household_list, "household list", [PERSON]),
            (self.segments, "segments", [PERSON]),
            (self.asks, "asks", [PERSON]),
            (self.phones, "phones", [PERSON]),
            (self.education, "education", [PERSON]),
            (self.final_ranking, "final ranking", [PERSON, "seq"]),
            (self.control_ranking, "control ranking", [PERSON, "seq"]),
            (w.constituent, "constituent", ["constituent_system_id"]),
            (w.gift, "gift", ["gift_fact_id"]),
            (w.gift_credit, "gift credit", ["gift_fact_id"]),
            (w.fund, "fund", ["fund_identifier"]),
            (w.calendar, "calendar", ["actual_date"]),
            (w.manager, "manager", [PERSON]),
        ]
        return [quality.Check(df, name, keys) for df, name, keys in keyed]

    @cached_property
    def violations(self) -> DataFrame:
        """How many rows repeat each of these keys."""
        return quality.check_all(self.checks)

    # --- extract ----------------------------------------------------------

    def _people(self) -> DataFrame:
        """Members with their own and their spouse's name and address."""
        person = [
            "constituent_id",
            "title",
            "first_name",
            F.col("surname").alias("last_name"),
            or_empty("nickname").alias("nickname"),
            or_empty("suffix").alias("suffix"),
            "salutation",
            "addressee",
            *[f"address{i}" for i in range(1, 6)],
            "city",
            "state",
            F.col("post_code").alias("zip"),
            or_empty("country").alias("country"),
            or_empty("email_address").alias("email"),
        ]
        spouse_fields = {
            "constituent_id": "spouse_constituent_id",
            "title": "spouse_title",
            "first_name": "spouse_first_name",
            "surname": "spouse_last_name",
            "nickname": "spouse_nickname",
            "suffix": "spouse_suffix",
        }
        spouses = self.wh.constituent.select(
            F.col("constituent_system_id").alias("spouse_constituent_system_id"),
            *[F.col(c).alias(name) for c, name in spouse_fields.items()],
        )
        people = self.wh.constituent.select(PERSON, "spouse_constituent_system_id", *person)
        members = merged_lookup(people, self.segments, PERSON, "inner")
        rows = sparse_lookup(members, spouses, "spouse_constituent_system_id", by=[PERSON])
        return rows.withColumns({n: or_empty(n) for n in spouse_fields.values()})

    def _figures(self) -> list[DataFrame]:
        """One row per person each, to be looked up on the person."""
        p, w = self.policy, self.wh
        employer = contacts.primary_employer(w.relationship, w.constituent).select(
            PERSON, F.col("full_name").alias("employer"), F.col("position").alias("job_title")
        )
        phones = self.phones.select(PERSON, "home_phone", F.col("home_cell").alias("cell_phone"))
        donor_types = self.donor_types.select(
            PERSON, F.col("dpag_donor_type_bucket").alias("donor_type")
        )
        last_gift = segments.last_giving_year(
            segments.ledger_years(self.ledger, self.projections, p.projection_reported_year),
            "last_gift_year",
        )
        amounts = segments.giving_summary(
            self.giving, {"prior_year_amount": p.prior_year, "report_year_amount": p.report_year}
        )
        loyalty = contacts.loyalty_years(w.constituent_attribute).withColumn("_loyal", F.lit(True))
        names = {"fund_description": "suggested_fund_description", "fund_identifier": "suggested_fund_id"}
        frequent = {"fund_description": "frequent_fund_description", "fund_identifier": "frequent_fund_id"}
        return [
            segments.manager_fallback(w.manager),
            employer,
            phones,
            donor_types,
            segments.production_summary(self.production_gifts, p.report_year, p.last_year_only),
            last_gift,
            amounts,
            loyalty,
            self._ends_a_stage("final_top", pivot_top_n(self.final_ranking, 3, values=names)),
            self._ends_a_stage("control_top", pivot_top_n(self.control_ranking, 3, values=frequent)),
            self.asks,
        ]

    def _ends_a_stage(self, name: str, df: DataFrame) -> DataFrame:
        """A table where stages are tables: a task holds the sorts of all joins of its stage.  A store's buckets are sorted."""
        return materialize(df, name, "table") if self.store is None and self.stage_mode == "table" else df

    @cached_property
    def extract_rows(self) -> DataFrame:
        """The extract before it is sorted."""
        rows = self._bucketed("people", self._people())
        for i, figures in enumerate(self._figures()):
            rows = lookup(rows, self._bucketed(f"figures_{i}", figures), PERSON)
            if i % FIGURES_AT_ONCE == FIGURES_AT_ONCE - 1:
                rows = self._ends_a_stage(f"people_{i}", rows)
        blanks = (
            *[f"manager_{i}" for i in (1, 2, 3)],
            "employer",
            "job_title",
            "home_phone",
            "cell_phone",
            *[
                f"{kind}_fund_{what}_{i}"
                for kind in ("suggested", "frequent")
                for i in (1, 2, 3)
                for what in ("description", "id")
            ],
        )
        years = ("last_annual_giving_year", "last_gift_year")
        amounts = ("prior_year_amount", "report_year_amount")
        return rows.withColumns(
            {
                **{c: or_empty(c) for c in blanks},
                **{c: or_empty(F.col(c).cast("string")) for c in years},
                **{c: or_empty(money_text(c)) for c in amounts},
                "loyalty_years": F.when(F.col("_loyal"), F.col("loyalty_years")).otherwise("0"),
                "report_year_donor_type": or_empty("donor_type"),
                "appeal_package": F.lit(self.policy.appeal_package),
            }
        ).select(*EXTRACT_COLUMNS)

    @cached_property
    def mail_extract(self) -> DataFrame:
        """One row per household, by id."""
        return self.extract_rows.orderBy(F.col("constituent_id").cast("bigint"))
