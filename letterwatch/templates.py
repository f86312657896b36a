"""The texts of the follow-up mails, by kind of message."""

FALLBACK_KIND = "Security Inquiry"

# ---- fixed values: kind -> (subject, body) ---------------------------------
TEMPLATES = {
    "Security Inquiry": (
        "Security Review Required: Email Activity Alert",
        """Dear [SENDER_NAME],

I hope this message finds you well. As part of our ongoing commitment to data security, we have identified some email activity that requires review.

Details:
- Email sent on: [EMAIL_DATE]
- Recipients: [RECIPIENTS]
- Risk Score: [RISK_SCORE]
- Reason for Review: [RISK_FACTORS]

This is a routine security measure to ensure compliance with our data protection policies. Please reply to this email with:

1. Confirmation that the email was sent intentionally
2. Brief description of the business purpose
3. Any additional context you feel is relevant

If you have any questions or concerns, please don't hesitate to contact our IT Security team.

Best regards,
IT Security Team
Email: security@company.com
Phone: (555) 123-4567""",
    ),
    "Data Classification Review": (
        "Data Classification Review Required: [EMAIL_SUBJECT]",
        """Dear [SENDER_NAME],

We are conducting a routine review of email communications that may contain sensitive information.

Email Details:
- Date: [EMAIL_DATE]
- Subject: [EMAIL_SUBJECT]
- Recipients: [RECIPIENTS]
- Risk Assessment: [RISK_LEVEL]

As part of our data governance procedures, we need to verify:

1. The classification level of the information shared
2. Whether recipients are authorized to receive this information
3. If any additional security measures should be applied

Please respond within 2 business days with:
- Confirmation of data sensitivity level (Public, Internal, Confidential, Restricted)
- Justification for sharing with external recipients (if applicable)
- Any remedial actions you recommend

Thank you for your cooperation in maintaining our security standards.

Best regards,
Data Governance Team
Email: datagovernance@company.com""",
    ),
    "Policy Reminder": (
        "Reminder: Email Security Best Practices",
        """Dear [SENDER_NAME],

This is a friendly reminder about our email security policies following recent activity that triggered our monitoring systems.

Recent Activity Summary:
- Date: [EMAIL_DATE]
- Risk Indicators: [RISK_FACTORS]

Please remember these key email security practices:

1. Verify recipient email addresses before sending sensitive information
2. Use secure file sharing services for large or confidential documents
3. Be cautious when emailing personal email addresses or free email providers
4. Consider email encryption for highly sensitive communications
5. Report any suspicious email activity immediately

For questions about appropriate email usage or security tools, please contact:
- IT Security Team: security@company.com
- Help Desk: (555) 123-4567

Thank you for helping us maintain a secure email environment.

Best regards,
IT Security Team""",
    ),
}
