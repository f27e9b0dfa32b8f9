from .mailing import MailingPlan

__all__ = ["MailingPlan"]
